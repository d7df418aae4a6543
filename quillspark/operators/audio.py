"""Numbers over arrays of audio samples and embeddings, and parameters of synthesis."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import ship_package
from .ranking import kept, running_total

#: Bounds of synthesis parameters.
BOUNDS = {"exaggeration": (0.1, 0.65, 2), "cfg_weight": (0.0, 1.0, 2), "temperature": (0.1, 2.35, 2), "min_p": (0.02, 0.3, 3), "repetition_penalty": (1.0, 2.0, 1)}
HUM_HZ, HUM_SHARE, HUM_LEVEL, HUM_STEADY = (50, 200), 0.3, (0.005, 0.1), 0.6


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(a, lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each key, scaled to length 1."""
    each = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    joined = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m")).withColumn("v", F.col("m.x"))
    return joined.select(*keys, F.transform("v", lambda x: x / norm(F.col("v"))).alias("vector"))


def health(samples: Column) -> Column:
    """Shares of clipped and silent samples, and mean over root mean square; four decimals."""
    n = F.size(samples)
    share = lambda f: F.bround(F.size(F.filter(samples, f)) / n, 4)
    mean = _sum(samples, lambda x: F.abs(x.cast("double"))) / n
    return F.struct(share(lambda x: F.abs(x) > 0.98).alias("clipping_ratio"), share(lambda x: F.abs(x) < 1e-4).alias("silence_ratio"), F.bround(mean / (rms(samples) + 1e-8), 4).alias("flatness"))


def rms(samples: Column) -> Column:
    return F.sqrt(_sum(samples, lambda x: x.cast("double") * x.cast("double")) / F.size(samples))


def windows(samples: Column, size: int, step: int | None = None) -> Column:
    """Windows of `size` samples that end before the last sample."""
    starts = F.when(F.size(samples) > size, F.sequence(F.lit(0), F.size(samples) - size - 1, F.lit(step or size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(samples, s + 1, size))


def mid_energy_drop(samples: Column, size: int, ratio: float | None = None) -> Column:
    """Two windows in a row, from the fourth on, below a share of the mean level."""
    levels = F.transform(windows(samples, size), rms)
    mean = _sum(levels, lambda x: x) / F.nullif(F.size(levels), F.lit(0))
    limit = mean * (F.lit(ratio) if ratio else F.when(mean < 0.01, 0.1).otherwise(0.2))
    low = F.transform(levels, lambda x, i: (i >= 3) & (x < limit))
    return F.coalesce(F.exists(F.zip_with(low, F.slice(low, 2, 1 << 20), lambda a, b: F.coalesce(a & b, F.lit(False))), lambda x: x), F.lit(False))


def peak(samples: Column, most: float = 1.0) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x))) / most


def peak_gain_db(level: Column, target_db: float) -> Column:
    """Gain to the target, at most 24 dB either way; null where there is no sound or under 0.05 dB to do."""
    gain = F.when(level > 0, F.lit(target_db) - F.log10(level) * 20)
    return F.when(F.abs(gain) >= 0.05, F.greatest(F.lit(-24.0), F.least(F.lit(24.0), gain)))


def with_pauses(segments: Column, pauses: Column, rate: int) -> Column:
    """Segments with that many zeros between them; there must be one pause less than segments."""
    zero = lambda p: F.array_repeat(F.lit(0.0).cast("float"), (p * rate).cast("int"))
    joined = F.flatten(F.transform(segments, lambda s, i: F.when(i == 0, s).otherwise(F.concat(zero(F.get(pauses, i - 1)), s))))
    return F.when(F.size(segments) == 0, F.array().cast("array<float>")).when(F.size(segments) == F.size(pauses) + 1, joined).otherwise(F.raise_error(F.lit("pauses do not match segments")).cast("array<float>"))


def silence_after(boundary: Column) -> Column:
    return F.coalesce(X.lookup(boundary, X.BOUNDARY_SILENCE_MS), F.lit(0))


def window_count(n: Column, size: int, step: int, least: float) -> Column:
    """struct(n_windows, target): one more window where what is left covers enough of it."""
    room = F.greatest(n - size + step, F.lit(0))
    whole, rest = F.floor(room / step), room % step
    count = whole + F.when((whole == 0) | ((rest + (size - step)) / F.lit(size) >= least), 1).otherwise(0)
    return F.struct(count.alias("n_windows"), (F.lit(size) + (count - 1) * step).alias("target"))


def partials(frames: Column, size: int, step: int, least: float = 0.8) -> Column:
    """Overlapping windows, zeros behind the last frame."""
    count = window_count(F.size(frames), size, step, least)["n_windows"]
    padded = F.concat(frames, F.array_repeat(F.lit(0.0).cast("float"), size))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(padded, (k * step + 1).cast("int"), size))


def padded_rows(rows: DataFrame, vector: str) -> DataFrame:
    """Arrays filled with zeros up to the longest."""
    most = rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("_most"))  # one row
    return rows.join(F.broadcast(most)).withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), F.col("_most") - F.size(vector)))).drop("_most")


def binned(value: Column, step: float = 0.05) -> Column:
    return F.bround(F.bround(value / step) * step, 3)


def bounded(value: Column, name: str) -> Column:
    low, high, digits = BOUNDS[name]
    return F.bround(F.greatest(F.lit(low), F.least(F.lit(high), value)), digits)


def sentiment_parameters(score: Column, base: dict[str, float], slope: dict[str, float]) -> Column:
    """Each parameter moved in proportion to the score, then bounded and rounded."""
    return F.struct(*[bounded(F.lit(base[k]) + score * F.lit(slope.get(k, 0.0)), k).alias(k) for k in base])


def retry_parameters(params: Column, score: Column, attempt: Column, steps: dict[str, float]) -> Column:
    """First retry: less temperature; second: less exaggeration and more guidance. Poor scores double the step, good ones halve it."""
    size = F.when(score < 0.3, 2.0).when(score < 0.6, 1.0).otherwise(0.5)
    low = lambda k: F.greatest(F.lit(BOUNDS[k][0]), params[k] - size * steps[k])
    high = F.least(F.lit(BOUNDS["cfg_weight"][1]), params["cfg_weight"] + size * steps["cfg_weight"])
    return F.struct(
        F.when(attempt == 1, low("temperature")).otherwise(params["temperature"]).alias("temperature"),
        F.when(attempt == 2, low("exaggeration")).otherwise(params["exaggeration"]).alias("exaggeration"),
        F.when(attempt == 2, high).otherwise(params["cfg_weight"]).alias("cfg_weight"),
    )


def attempt_parameters(params: Column, attempt: Column, temperature: float = 0.1, exaggeration: float = 0.05, first: int = 1) -> Column:
    """Temperature and exaggeration lowered step by step, not below their bounds. first=2 leaves the first attempt as it is."""
    n = F.greatest(F.lit(0), attempt - (first - 1))
    return F.struct(F.greatest(F.lit(BOUNDS["temperature"][0]), params["temperature"] - n * temperature).alias("temperature"), F.greatest(F.lit(BOUNDS["exaggeration"][0]), params["exaggeration"] - n * exaggeration).alias("exaggeration"))


def retry_plan(failed: DataFrame, attempts: int, batch: int) -> DataFrame:
    """failed (chunk_id, temperature, exaggeration, segments array<string>): a row for each attempt and segment with its
    parameter group and batch of at most `batch` segments in it."""
    failed = kept(failed.select("chunk_id", "temperature", "exaggeration", "segments").withColumn("_row", F.monotonically_increasing_id()))
    # segments are numbered by their counts: no text is sorted or told once for each attempt
    light = failed.select("_row", "chunk_id", "temperature", "exaggeration", F.size("segments").alias("_n")).where("_n > 0").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    light = light.withColumn("p", attempt_parameters(F.struct("temperature", "exaggeration"), F.col("attempt"))).select("_row", "chunk_id", "attempt", "p", "_n")
    light = running_total(light, ["p"], ["chunk_id", "attempt", "_row"], F.col("_n"), "_before")  # few parameter groups, each in many tasks
    rows = failed.select("_row", "segments").join(light, "_row").select("chunk_id", "attempt", "p", "_before", F.posexplode("segments").alias("segment", "text"))
    return rows.select("chunk_id", "attempt", "p.temperature", "p.exaggeration", "segment", "text", F.floor((F.col("_before") + F.col("segment")) / batch).alias("batch"))


def renest(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Rows back to one array for each key, in order of position."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("i"), F.col(value).alias("v")))).alias("m")).select(*keys, F.col("m.v").alias(value))


#: Frame, step, bands and coefficients of the cepstra, decibels under the loudest band that count, and the jump of
#: variance between neighbouring coefficients that is worth no mark; weights of that mark and the mark for spread.
FRAME, STEP, BANDS, CEPSTRA, RANGE_DB, MOST_JUMP, MARK_WEIGHTS = 2048, 512, 128, 13, 80.0, 100.0, (0.6, 0.4)


@lru_cache(8)
def _mel_bands(rate: int) -> np.ndarray:
    """Triangles of equal area over the spectrum of a frame: evenly spaced up to 1,000 Hz, by ratio above (27 steps for a factor of 6.4)."""
    top = rate / 2
    linear, ratio = 200 / 3, np.log(6.4) / 27
    last = top / linear if top <= 1000 else 15 + np.log(top / 1000) / ratio
    mel = np.linspace(0, last, BANDS + 2)
    edges = np.where(mel <= 15, mel * linear, 1000 * np.exp(ratio * (mel - 15)))
    low, middle, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    hz = np.fft.rfftfreq(FRAME, 1 / rate)[None]
    return np.maximum(0, np.minimum((hz - low) / (middle - low), (high - hz) / (high - middle))) * 2 / (high - low)


def mel_cepstra(y: np.ndarray, rate: int, block: int = 1024) -> np.ndarray:
    """CEPSTRA coefficients for each frame; the clip is padded by half a frame of silence. Spectra are taken for `block` frames at a time."""
    padded = np.pad(y, FRAME // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::STEP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    power = np.concatenate([np.abs(np.fft.rfft(frames[k : k + block] * window)) ** 2 @ _mel_bands(rate).T for k in range(0, len(frames), block)])
    db = 10 * np.log10(np.maximum(power, 1e-10))
    db = np.maximum(db, db.max() - RANGE_DB)
    waves = np.cos(np.pi * np.outer(2 * np.arange(BANDS) + 1, np.arange(CEPSTRA)) / (2 * BANDS)) * np.sqrt(2 / BANDS)
    waves[:, 0] /= np.sqrt(2)
    return db @ waves


def artifact_marks(y: np.ndarray, rate: int) -> tuple[float, float]:
    """The mark for even cepstra (1 is best), and that mark weighted with the one for spread."""
    jump = float(np.abs(np.diff(mel_cepstra(y, rate).var(axis=0))).max())
    even, calm = 1 - min(jump / MOST_JUMP, 1.0), 1 - min(float(np.var(np.abs(y))) / 0.1, 1.0)
    return even, MARK_WEIGHTS[0] * even + MARK_WEIGHTS[1] * calm


FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("hum_ratio", "steady_ratio", "spectral_score", "cepstral_score", "artifact_score", "end_rms_ratio", "end_zero_crossings", "end_low_share", "centroid_hz", "noise_floor_db")] + [T.StructField("hum", T.BooleanType()), T.StructField("end_artifact", T.BooleanType()), T.StructField("trim_at", T.LongType())])


#: What marks the end of a clip as broken (level against the middle, zero crossings, share below 150 Hz); how often the threshold makes
#: a window loud, or fair, and the share of the ten windows from a loud one that must be over it.
END_RATIO, END_CROSSINGS, END_LOW, LOW_HZ = 0.6, 0.2, 0.4, 150
LOUD, FAIR, LOUD_SHARE = 3, 2, 0.3


def _features(y: np.ndarray, rate: int, threshold: float) -> dict:
    spectrum, hz = np.abs(np.fft.rfft(y)), np.fft.rfftfreq(len(y), 1 / rate)
    band = (hz >= HUM_HZ[0]) & (hz <= HUM_HZ[1])
    level = lambda x: float(np.sqrt(np.mean(x * x)))
    quarter = max(1, rate // 4)
    levels = [level(y[i : i + quarter]) for i in range(0, len(y) - quarter, quarter)]
    steady = sum(HUM_LEVEL[0] < v < HUM_LEVEL[1] for v in levels) / len(levels) if levels else 0.0
    hum = float(spectrum[band].sum() / (spectrum.sum() + 1e-10))
    out = {"hum_ratio": hum, "steady_ratio": steady, "hum": hum > HUM_SHARE and steady > HUM_STEADY, "spectral_score": 1 - min(float(np.var(np.abs(y))) / 0.1, 1.0)}
    out["cepstral_score"], out["artifact_score"] = artifact_marks(y, rate)
    size = rate // 10
    if len(y) >= 2 * size > 0:
        end, middle = y[-size:], y[len(y) // 2 : len(y) // 2 + size]
        e, f = np.abs(np.fft.rfft(end)), np.fft.rfftfreq(size, 1 / rate)
        ratio, crossings, low = level(end) / (level(middle) + 1e-10), float(np.mean(np.diff(np.sign(end)) != 0)), float(e[f < LOW_HZ].sum() / (e.sum() + 1e-10))
        out |= {"end_rms_ratio": ratio, "end_zero_crossings": crossings, "end_low_share": low, "end_artifact": ratio > END_RATIO or crossings > END_CROSSINGS or low > END_LOW}
    else:
        out |= {"end_rms_ratio": None, "end_zero_crossings": None, "end_low_share": None, "end_artifact": False}
    half = spectrum[: max(1, len(y) // 2)]
    out["centroid_hz"] = float((hz[: len(half)] * half).sum() / half.sum()) if half.sum() else 0.0
    quiet = np.sort(np.abs(y))[: int(len(y) * 0.1)]
    out["noise_floor_db"] = float(20 * np.log10((quiet.mean() if len(quiet) else 0.0) + 1e-10))
    window = max(2, rate // 20)
    loud = np.array([level(y[i : i + window]) for i in range(0, len(y) - window, window // 2)])
    strong = [i for i in np.flatnonzero(loud > LOUD * threshold)[::-1] if (loud[i : i + 10] > threshold).sum() >= max(1, LOUD_SHARE * min(10, len(loud) - i))]
    fair = np.flatnonzero(loud > FAIR * threshold)
    at = strong[0] if strong and strong[0] else (fair[-1] if len(fair) else 0)
    return out | {"trim_at": int(at) * (window // 2)}


def audio_features(spark: SparkSession, rate: int, threshold: float = 0.01):
    """A pandas UDF on arrays of samples: hum, spread, evenness of cepstra, end of the clip, centroid, noise floor, and the sample at which speech ends."""
    ship_package(spark)

    @F.pandas_udf(FEATURES)
    def features(samples: pd.Series) -> pd.DataFrame:
        rows = [_features(np.asarray(s, np.float64), rate, threshold) if s is not None and len(s) else dict.fromkeys(FEATURES.names) for s in samples]
        return pd.DataFrame(rows, columns=FEATURES.names)

    return features


#: Seconds of a level window, level that counts as clipped, weights of the marks of a recording.
SECONDS, CLIPPED = 5, 0.95
MARKS = {"fidelity": 0.25, "range": 0.25, "clipping": 0.25, "evenness": 0.15, "standards": 0.10}


def recording_marks(rate: int, dynamic_db: Column, clipped_percent: Column, spread: Column, seconds: Column, common_format: bool) -> dict[str, Column]:
    """Marks for sampling rate, dynamic range, clipping, evenness and delivery standards."""

    def marks(value: Column, steps: list[tuple[float, int]], rest: int, above: bool) -> Column:
        out = None
        for limit, mark in steps:
            cond = value >= limit if above else value < limit
            out = F.when(cond, mark) if out is None else out.when(cond, mark)
        return out.otherwise(rest)

    return {
        "fidelity": F.lit(100 if rate >= 44100 else 80 if rate >= 22050 else 60),
        "range": marks(dynamic_db, [(60, 100), (40, 80), (20, 60)], 40, True),
        "clipping": marks(clipped_percent, [(0.01, 100), (0.1, 80), (1.0, 60)], 30, False),
        "evenness": F.when(spread.isNull(), 90).otherwise(marks(spread, [(0.1, 100), (0.2, 80), (0.3, 60)], 40, False)),
        "standards": F.lit(100 - (0 if common_format else 10) - (0 if rate in (22050, 44100, 48000) else 10)) - F.when(seconds < 300, 20).otherwise(0),
    }


def recording_score(rate: int, dynamic_db: Column, clipped_percent: Column, spread: Column, seconds: Column, common_format: bool) -> Column:
    """Weighted marks for sampling rate, dynamic range, clipping, evenness and delivery standards."""
    marks = recording_marks(rate, dynamic_db, clipped_percent, spread, seconds, common_format)
    return sum((marks[k] * w for k, w in MARKS.items()), F.lit(0.0))


def recording_report(rows: DataFrame, keys: list[str], samples: str, rate: int, common_format: bool) -> DataFrame:
    """One row for each recording (keys): levels and range in decibels, clipped percent, centroid, the five marks and their weighted sum. Null or
    empty recordings have nulls. The centroid and the noise floor come from `audio_features`, all else stays in the JVM."""
    y = F.when(F.size(samples) > 0, F.col(samples))
    decibels = lambda c: 20 * F.log10(c + 1e-10)
    levels = F.transform(windows(y, rate * SECONDS), rms)
    n = F.size("_levels")
    mean = _sum(F.col("_levels"), lambda x: x) / n
    spread = F.when(n > 1, F.sqrt(_sum(F.col("_levels"), lambda x: (x - mean) * (x - mean)) / n) / F.nullif(mean, F.lit(0.0)))
    one = rows.select(*keys, y.alias("_y"), audio_features(rows.sparkSession, rate)(F.col(samples)).alias("_f"), levels.alias("_levels"))
    out = one.select(
        *keys,
        (F.size("_y") / rate).alias("seconds"),
        decibels(rms(F.col("_y"))).alias("rms_db"),
        decibels(peak(F.col("_y"))).alias("peak_db"),
        (decibels(peak(F.col("_y"))) - F.col("_f.noise_floor_db")).alias("dynamic_db"),
        F.col("_f.noise_floor_db").alias("noise_floor_db"),
        (100 * F.size(F.filter("_y", lambda x: F.abs(x) >= CLIPPED)) / F.size("_y")).alias("clipped_percent"),
        F.col("_f.centroid_hz").alias("centroid_hz"),
        spread.alias("level_spread"),
    )
    marks = recording_marks(rate, F.col("dynamic_db"), F.col("clipped_percent"), F.col("level_spread"), F.col("seconds"), common_format)
    known = F.col("dynamic_db").isNotNull()
    out = out.select("*", *(F.when(known, m).alias(f"{k}_mark") for k, m in marks.items()))
    return out.withColumn("overall", sum((F.col(f"{k}_mark") * w for k, w in MARKS.items()), F.lit(0.0)))
