"""Operator 2: mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents are pre-aggregated to cells (source, language, topic) with their tokens. The cells' shares are raked to the
targets of the three marginals in turn; after each round a share is held at what the cell has at all. Rounds go on until no share
moves by more than `tolerance`, or, where targets are only met in the limit (a share has to go to 0), up to MOST_ROUNDS. What those holds keep back of the budget then goes to the cells that have more, in proportion to their
shares. A cell's documents are sampled with the probability that gives it its share of the token budget. `marginals` tells how
far each target, and the budget, is from what is expected: a target of more tokens than there are cannot be met.

The cell table is as small as its three dictionaries make it; up to MOST_LOCAL cells it is raked in one partition, which no window
then has to deal anew, and is broadcast to the documents. Larger tables are dealt by the marginal at hand (cells of one language
meet in one task, which sorts them and may spill) and joined to the documents with large cells in pieces. Both give the same result.

Targets: unless given, a marginal's target is its tokens to the power `temper`, normalised.

Defined results: tokens are runs of characters other than space, \\t, \\n, \\v, \\f and \\r; null has none. Null source or
language is the cell value `unknown`. A document without tokens is kept if its cell is (its probability is the cell's;
a cell without tokens has probability 0). A document's draw depends on its doc_id alone (without one: on its text), so
repeated rows share a fate; a draw equal to the probability is not kept. Texts of any length are read whole. Given targets are
normalised; values without a target get 0. An empty table gives an empty result. Other columns pass through, whatever their names;
an input column `_mix` gives way in `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import checkpointed, dealt_join

DIMS = ("source", "lang", "topic")
MOST_LOCAL, MOST_ROUNDS = 200_000, 200
#: Shares that still move by so much after MOST_ROUNDS are no result; what moves less is taken, and `marginals` tells what is left.
MOST_MOVED = 1e-3
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"


def topic(text: Column) -> Column:
    """The kind of a text: table, code, short or prose."""
    return F.when(text.contains("|"), "table").when(text.rlike("[{};]"), "code").when(F.coalesce(F.length(text), F.lit(0)) < 400, "short").otherwise("prose")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit(f":{seed}")), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, rate: float = 0.5, tolerance: float = 1e-10, local: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens, others) with probability and the target shares target_source, target_lang, target_topic.
    local: in one partition, so that no window deals the cells anew."""
    near = lambda df: df.coalesce(1) if local else df
    cells = near(cells)
    whole = lambda d: F.sum("tokens").over(W.partitionBy(d))
    # Each of a marginal's n cells adds 1/n of its tempered weight.
    weights = {d: F.pow(whole(d).cast("double"), F.lit(temper)) for d in DIMS}
    parts = cells.select("tokens", *((weights[d] / F.count("*").over(W.partitionBy(d))).alias(d) for d in DIMS))
    sums = parts.agg(*(F.sum(c).alias(c) for c in ("tokens", *DIMS))).first()  # four numbers
    total = float(sums.tokens or 0)

    def target(d: str) -> Column:
        if targets and d in targets:
            return F.coalesce(*[F.when(F.col(d) == k, F.lit(v / sum(targets[d].values()))) for k, v in targets[d].items()], F.lit(0.0))
        return weights[d] / F.lit(sums[d] or 1.0)

    share = F.col("tokens") / F.lit(total or 1.0)
    out = cells.select("*", *(target(d).alias(f"target_{d}") for d in DIMS), (share / F.lit(rate)).alias("_cap"), share.alias("_x"))
    moved, rounds = 1.0, 0
    while moved > tolerance and total:
        if rounds >= MOST_ROUNDS:
            if moved > MOST_MOVED:
                raise ValueError(f"shares still move by {moved} after {rounds} rounds")
            break
        for k in range(5):
            if k == 4:
                out = out.withColumn("_was", F.col("_x"))
            for d in DIMS:
                now = F.sum("_x").over(W.partitionBy(d))
                out = out.withColumn("_x", F.when(now > 0, F.col("_x") * F.col(f"target_{d}") / now).otherwise(0.0))
            out = out.withColumn("_x", F.least("_x", "_cap"))
        out = near(checkpointed(out))
        moved, rounds = out.agg(F.max(F.abs(F.col("_x") - F.col("_was")))).first()[0], rounds + 5
        out = out.drop("_was")
    lift = 1.0
    while total:  # the least factor that spends the budget, found from below in finitely many steps
        full = F.col("_x") * lift >= F.col("_cap")
        held, free = out.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_x")))).first()
        if free <= 0 or (1 - held) / free <= lift * (1 + 1e-12):
            break
        lift = (1 - held) / free
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("_x") * lift / F.col("_cap"))).otherwise(0.0)
    return out.withColumn("probability", p).drop("_x", "_cap")


def marginals(raked: DataFrame, rate: float = 0.5) -> DataFrame:
    """Of raked cells: rows (marginal, value, target, expected, residual), shares of the token budget; one row is the budget itself."""
    budget = F.lit(float(raked.agg(F.sum("tokens")).first()[0] or 0) * rate or 1.0)
    kept = F.sum(F.col("tokens") * F.col("probability")) / budget
    parts = [raked.groupBy(F.lit(d).alias("marginal"), F.col(d).alias("value")).agg(F.max(f"target_{d}").alias("target"), kept.alias("expected")) for d in DIMS]
    parts.append(raked.groupBy(F.lit("budget").alias("marginal"), F.lit("tokens").alias("value")).agg(F.lit(1.0).alias("target"), kept.alias("expected")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("residual", F.col("expected") - F.col("target"))


def _cells(docs: DataFrame) -> tuple[Column, Column, DataFrame]:
    text = F.col("text")
    keys = F.struct(F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"), topic(text).alias("topic"))
    tokens = F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
    keyed = docs.select(keys.alias("k"), tokens.alias("tokens"))
    return keys, tokens, checkpointed(keyed.groupBy("k").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).select("k.*", "tokens", "docs"))


def raked_cells(docs: DataFrame, **how) -> DataFrame:
    """The cells of docs with their probabilities and targets."""
    cells = _cells(docs)[2]
    return rake(cells, local=cells.count() <= MOST_LOCAL, **how)


def _mixed(docs: DataFrame, seed: int, **how) -> DataFrame:
    """docs as a struct `row`, and `mix`."""
    keys, tokens, cells = _cells(docs)
    local = cells.count() <= MOST_LOCAL
    raked = checkpointed(rake(cells, local=local, **how))
    side = raked.select(F.struct(*DIMS).alias("cell"), "docs", "probability")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), keys.alias("cell"), tokens.alias("tokens"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    if local:
        rows = rows.join(F.broadcast(side.drop("docs")), "cell")
    else:
        rows = dealt_join(rows, side, ["cell"], "docs", docs.count())
    return rows.select("row", F.struct("cell.source", "cell.lang", "cell.topic", "tokens", "probability", (F.col("draw") < F.col("probability")).alias("kept")).alias("mix"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, rate: float = 0.5, seed: int = 1) -> DataFrame:
    """docs (doc_id, text, source, lang, others) with `_mix`: struct of source, lang, topic, tokens, probability, kept."""
    out = _mixed(docs, seed, targets=targets, temper=temper, rate=rate)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "_mix"), F.col("mix").alias("_mix"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, rate: float = 0.5, seed: int = 1) -> DataFrame:
    """The rows of docs that the mix keeps, with the columns of docs."""
    return _mixed(docs, seed, targets=targets, temper=temper, rate=rate).where("mix.kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", F.col("_mix.source").alias("source"), F.col("_mix.lang").alias("lang"), F.col("_mix.topic").alias("topic"), F.col("_mix.tokens").alias("tokens"), F.round("_mix.probability", 6).alias("probability"), F.col("_mix.kept").alias("kept"))


def _oracle(temper: float = 0.5, rounds: int = 20, lifts: int = 12, rate: float = 0.5, seed: int = 1) -> str:
    """The SQL form with enough rounds for shares that move by less than 1e-10, and enough steps of the factor that spends the budget."""
    parts = [
        r"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[{};]') THEN 'code' WHEN coalesce(length(text), 0) < 400 THEN 'short' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        *(f"m_{x} AS (SELECT {x}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS t_{x} FROM c GROUP BY {x})" for x in DIMS),
        f"x0 AS (SELECT c.*, t_source, t_lang, t_topic, tokens / sum(tokens) OVER () AS x, tokens / (sum(tokens) OVER () * {rate}) AS cap FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))",
    ]
    for k in range(rounds):
        at = f"x{k}"
        for x in DIMS:
            parts.append(f"{at}_{x} AS MATERIALIZED (SELECT * REPLACE (x * t_{x} / sum(x) OVER (PARTITION BY {x}) AS x) FROM {at})")
            at = f"{at}_{x}"
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(x, cap) AS x) FROM {at})")
    parts.append("l0 AS (SELECT 1.0::DOUBLE AS l)")
    for k in range(lifts):
        parts.append(
            f"l{k + 1} AS MATERIALIZED (SELECT greatest(any_value(l), coalesce((1 - sum(CASE WHEN x * l >= cap THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN x * l < cap THEN x ELSE 0 END), 0), 0)) AS l FROM x{rounds}, l{k})"
        )
    return f"""WITH {", ".join(parts)}
SELECT doc_id, source, lang, topic, d.tokens::BIGINT AS tokens, round(p, 6) AS probability,
  ('0x' || substr(sha256(doc_id::VARCHAR || ':{seed}'), 1, 12))::BIGINT / {16**12}.0::DOUBLE < p AS kept
FROM d JOIN (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, x * l / cap) ELSE 0.0 END AS p FROM x{rounds}, l{lifts}) USING (source, lang, topic)"""


ORACLE_SQL = _oracle()
