"""Text cut into pieces: pause tags, real sentences, long sentences, bounded chunks. Plain Python on one text, with Arrow wrappers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

#: Abbreviations whose full stop ends no sentence; pause in milliseconds after a mark.
ABBREVIATIONS = frozenset("mr mrs ms dr jr sr vs etc st no prof rev gen col sgt lt mt ft inc ltd co vol pp ch fig approx est".split())
PAUSES_MS = {".": 300, "?": 350, "!": 598}
TAG = re.compile(r"\[pause:(\d+)ms\]")
CLOSERS = "\"'”’)"


def ends_sentence(text: str, at: int) -> bool:
    """Whether the mark at `at` ends a sentence: not in a decimal, after an abbreviation or a lone letter, or before a letter."""
    if text[at] == ".":
        if text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit():
            return False
        word = re.search(r"([^\W\d_]*)[\W_]*$", text[:at])
        if word and (word[1].lower() in ABBREVIATIONS or len(word[1]) == 1):
            return False
    after = text[at + 1 : at + 2]
    return not after or after.isspace() or after in CLOSERS or bool(TAG.match(text, at + 1))


def real_sentences(text: str | None) -> list[str]:
    raw, out, start = (text or "").strip(), [], 0
    for m in re.finditer(r"[.?!]", raw):
        if m.start() >= start and ends_sentence(raw, m.start()):
            end = m.end()
            while end < len(raw) and raw[end] in CLOSERS:
                end += 1
            out.append(raw[start:end].strip())
            start = end
    out.append(raw[start:].strip())
    return [s for s in out if s] or ([raw] if raw else [])


def speaks(text: str) -> bool:
    return any(c.isalnum() for c in text)


def split_pauses(text: str | None) -> tuple[list[str], list[float]]:
    """(segments, seconds between them). Zero tags do not cut, adjacent tags add up, pieces without speech go, short tails without
    a mark join the piece before; each segment is cut at its sentences with no pause between those. A tag after the last speech
    is a last pause; a text of tags alone has only pauses."""
    parts = TAG.split(text or "")
    pieces: list[tuple[float, str]] = []  # (pause before, text)
    wait, now = 0.0, parts[0]
    for ms, rest in zip(parts[1::2], parts[2::2], strict=True):
        if int(ms) == 0:
            now += rest
            continue
        if now.strip():
            pieces.append((wait, now.strip()))
            wait = 0.0
        wait += int(ms) / 1000
        now = rest
    if now.strip():
        pieces.append((wait, now.strip()))
        wait = 0.0
    segments: list[str] = []
    pauses: list[float] = []
    for pause, piece in pieces:
        if not speaks(piece):
            continue
        if segments and len(piece.split()) < 3 and piece[-1] not in ".!?":
            segments[-1] += " " + piece
            continue
        if segments and pause:
            pauses.append(pause)
        segments.append(piece)
    if not segments:
        if wait or any(p for p, _ in pieces):
            return [], [wait] if wait else [p for p, _ in pieces if p]
        plain = TAG.sub(" ", text or "").strip()
        return [plain or (text or "")], []
    if wait:
        pauses.append(wait)
    out, gaps = [], []
    for k, segment in enumerate(segments):
        for n, sentence in enumerate(real_sentences(segment) or [segment]):
            if out:
                gaps.append(pauses[k - 1] if n == 0 and k - 1 < len(pauses) else 0.0)
            out.append(sentence)
    return out, gaps + pauses[len(segments) - 1 :]


def add_pauses(text: str | None, pauses: dict[str, int] = PAUSES_MS) -> str | None:
    """A tag in place of each mark with a pause: . ? and ! at ends of sentences, other marks anywhere; tags that are there stay,
    and a tag right behind a mark takes its place."""
    if not text:
        return text
    for mark in sorted((m for m, ms in pauses.items() if ms > 0), key=lambda m: (m in PAUSES_MS, -len(m))):
        out, at = "", 0
        for m in re.finditer(re.escape(mark), text):
            if m.start() < at or any(t.start() <= m.start() < t.end() for t in TAG.finditer(text)) or (mark in ".?!" and not ends_sentence(text, m.start())):
                continue
            behind = re.match(r"\s*(\[pause:\d+ms\])?\s*", text[m.end() :])
            out = (out + text[at : m.start()]).rstrip() + f" {behind[1] or f'[pause:{pauses[mark]}ms]'} "
            at = m.end() + behind.end()
        text = out + text[at:]
    return text


def break_long(sentence: str, most: int, marks: tuple[str, ...] = (r";\s*", r"—\s*", r"–\s*", r",\s*")) -> list[str]:
    """A sentence cut at the last mark of the first kind that leaves at most `most` words before it; whole where none does."""
    out, rest = [], sentence.strip()
    while len(rest.split()) > most:
        cut = next((m.end() for p in marks for m in reversed(list(re.finditer(p, rest))) if len(rest[: m.end()].split()) <= most), None)
        if cut is None:
            break
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [*out, rest] if rest else out


def chunk_text(text: str | None, most: int = 28, least: int = 4, mode: str = "word_cap", paragraph: str = "\n\n") -> list[tuple[str, bool]]:
    """(chunk, ends its paragraph) of a text. Headings stand alone at first. word_cap: sentences, long ones cut, neighbours joined
    while they fit; sentence_pack: whole sentences until `least` words."""
    rows: list[tuple[str, bool]] = []
    for p in filter(None, (q.strip() for q in (text or "").split(paragraph))):
        if re.search("chapter|section|part|prologue|epilogue", p.lower()) and len(p.split()) <= 10:
            rows.append((p, True))
            continue
        parts = re.split(r"(?<=[.!?])\s+", p)
        sentences = [s for s in (x.strip() for x in parts) if s and s not in (".", "!", "?")]
        if mode == "sentence_pack":
            pack: list[str] = []
            for k, s in enumerate(sentences):
                pack.append(s)
                if k == len(sentences) - 1 or sum(len(x.split()) for x in pack) >= least:
                    rows.append((" ".join(pack), k == len(sentences) - 1))
                    pack = []
        else:
            pieces = [b for s in sentences for b in (break_long(s, most) if len(s.split()) > most else [s])]
            rows += [(b, k == len(pieces) - 1) for k, b in enumerate(pieces)]
    if mode == "sentence_pack":
        return rows
    out: list[tuple[str, bool]] = []
    for piece, end in rows:
        if out and (len(out[-1][0].split()) + len(piece.split()) <= most or len(out[-1][0].split()) < least):
            out[-1] = (out[-1][0] + " " + piece, end)
        else:
            out.append((piece, end))
    return out


def pack_characters(text: str | None, most: int = 300) -> list[str]:
    """Sentences packed into pieces of at most `most` characters; longer ones cut at commas, then at spaces, then anywhere."""

    def pack(parts: list[str], glue: str, finer: Callable[[str], list[str]]) -> list[str]:
        out: list[str] = []
        for p in parts:
            if len(p) > most:
                out += finer(p)
            elif out and len(out[-1]) + len(glue) + len(p) <= most:
                out[-1] += glue + p
            else:
                out.append(p)
        return out

    hard = lambda w: [w[k : k + most] for k in range(0, len(w), most)]
    spaces = lambda s: pack(s.split(), " ", hard)
    commas = lambda s: pack([x for x in re.split(r"(?<=,)\s*", s) if x], " ", spaces)
    return pack([s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if s], " ", commas)


EAST_ASIAN = re.compile("[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]")


def cut_at_words(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, cut behind marks, then at spaces, or anywhere in scripts without spaces (over 0.3 of the
    letters) and in longer words."""
    letters = re.sub(r"\s+", "", text)
    east = bool(letters) and len(EAST_ASIAN.findall(letters)) / len(letters) > 0.3
    out: list[str] = []
    for part in re.split(r"(?<=[、。，；：！？])" if east else r"(?<=[,;:.!?])\s+", text):
        if len(part) <= most:
            out.append(part)
        elif east:
            out += [part[k : k + most] for k in range(0, len(part), most)]
        else:
            now = ""
            for word in part.split():
                pieces = [word[k : k + most] for k in range(0, len(word), most)]
                for piece in pieces:
                    if now and len(now) + 1 + len(piece) <= most and piece is pieces[0]:
                        now += " " + piece
                    else:
                        out += [now] if now else []
                        now = piece
            out += [now] if now else []
    return [p for p in out if p]


def segmented(text: str | None, least: int, most: int) -> list[str]:
    """Paragraphs, their sentences, short ones joined, long ones cut; each piece has at most `most` characters."""
    out: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*", paragraph) if s]
        out += [piece for s in merge_short(sentences, least, most) for piece in ([s] if len(s) <= most else cut_at_words(s, most))]
    return out


def merge_short(pieces: list[str], least: int, most: int) -> list[str]:
    """Neighbours joined while a piece has fewer than `least` characters and both fit `most`."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) < least and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def windows_of(tokens: list, size: int = 950) -> list[list]:
    return [tokens[k : k + size] for k in range(0, len(tokens), size)]


def split_dialogue(sentence: str, most: int, depth: int = 3) -> list[str]:
    """Speech cut before its attribution, else at inner marks, else in halves of words."""
    words = sentence.split()
    if len(words) <= most or depth == 0:
        return [sentence.strip()] if sentence.strip() else []
    said = re.search(r"[,\"”]\s+(?=(?:he|she|they|I|[A-Z]\w+)\s+(?:said|asked|replied|whispered|shouted)\b)", sentence)
    inner = break_long(sentence, most, (r"[.!?]\s+", r";\s*", r"—\s*", r",\s*"))
    if said and said.start():
        halves = [sentence[: said.end()], sentence[said.end() :]]
    elif len(inner) > 1:
        halves = inner
    else:
        halves = [" ".join(words[:most]), " ".join(words[most:])]
    return [p for h in halves for p in split_dialogue(h, most, depth - 1)]


def restore_special(text: str | None) -> str:
    """Lower case but for [SPECIAL] tokens, in compatibility decomposition."""
    low = re.sub(r"\[([a-z_]+)\]", lambda m: f"[{m[1].upper()}]", (text or "").lower())
    return unicodedata.normalize("NFKD", low)


#: Rows whose texts and results are Python objects at a time.
ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most `rows` rows, as the results of a text take many times its size."""
    for b in batches:
        yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))


def map_text(df: DataFrame, column: str, keep: list[str], func: Callable[[str | None], dict], fields: dict[str, tuple[pa.DataType, str]], spread: bool = False) -> DataFrame:
    """keep columns and the fields that func gives for a text column, in Arrow batches. spread: deal the rows anew first, for work
    that is far more than their transport."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [func(x) for x in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array([f[n] for f in found], t) for n, (t, _) in fields.items())], [*keep, *fields])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), *(f"{n} {s}" for n, (_, s) in fields.items())])
    rows = df.select(*keep, df[column].alias("_text"))
    if spread and not df.isStreaming:
        rows = rows.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.mapInArrow(run, schema)


STRINGS = (pa.list_(pa.string()), "array<string>")


def pause_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return map_text(df, column, keep, lambda t: dict(zip(("segments", "pauses"), split_pauses(t), strict=True)), {"segments": STRINGS, "pauses": (pa.list_(pa.float64()), "array<double>")})


def chunk_lists(df: DataFrame, column: str, keep: list[str], **how) -> DataFrame:
    """One row for each text: keep, chunks (structs of text and is_paragraph_end); no chunks for a text without words, null for a null."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("is_paragraph_end", pa.bool_())]))
    chunks = lambda t: None if t is None else [{"text": a, "is_paragraph_end": b} for a, b in chunk_text(t, **how)]
    return map_text(df, column, keep, lambda t: {"chunks": chunks(t)}, {"chunks": (kind, "array<struct<text:string,is_paragraph_end:boolean>>")})


def chunk_rows(df: DataFrame, column: str, keep: list[str], **how) -> DataFrame:
    """One row for each chunk: keep, idx, text, is_paragraph_end."""
    from pyspark.sql import functions as F

    return chunk_lists(df, column, keep, **how).select(*keep, F.posexplode("chunks").alias("idx", "c")).select(*keep, "idx", "c.text", "c.is_paragraph_end")
