"""Operator 7: license scans by MinHash bands over overlapping windows and exact containment.

Templates of n words (five at least) belong to the window class L, the power of two at or above n (8 at least). Windows of
that class hold 2 L words and start every L words, so each occurrence of n words lies whole in one of them. A window's
signature has 128 MinHash values over its five-word shingles, each a band of its own. A window that contains 0.8 of a
template's shingles has a Jaccard similarity of 1/12 at least with it, so the chance that no band meets is under
(1 - 1/12)**128 < 2e-5 (`guarantee`). Templates that meet in a band are verified: the exact share of their shingles in
the window. Windows without any shingle of any template can't meet in a band and get no signature.

Defined results: rows only for documents with a match, one for each document row and license: its best window (the
first of equals). Texts of any length are read whole, in slices. A null or empty text and one of fewer than five words match nothing. Repeated rows match alike; null
ids pass; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words
from ._common import python_ready

GRAM, BANDS = 5, 128

#: Public license notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def guarantee(words: int, threshold: float) -> float:
    """Chance that a window with `threshold` of a template's shingles meets it in a band."""
    size = window_class(words)
    m = words - GRAM + 1
    need = int(np.ceil(threshold * m))
    jaccard = need / (2 * size - GRAM + 1 + m - need)
    return 1 - (1 - jaccard) ** BANDS


def window_class(words: int) -> int:
    return max(8, 1 << (words - 1).bit_length())


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.threshold = list(templates), threshold
        h, rows, *_ = _words.words(pa.array(list(templates.values()), pa.string()))
        self.sets = [np.unique(s) for s in _words.shingles(h, rows, GRAM)]
        if min(np.diff(rows), default=GRAM) < GRAM:
            raise ValueError("templates need five words or more")
        self.hashes = _words.MinHash(BANDS, seed=7)
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(rows)):
            self.classes.setdefault(window_class(int(n)), []).append(i)
        self.bands = {size: [dict() for _ in range(BANDS)] for size in self.classes}
        for size, members in self.classes.items():
            for i in members:
                for band, value in zip(self.bands[size], self.hashes.signature(self.sets[i]).tolist(), strict=True):
                    band.setdefault(value, []).append(i)
        self.all = np.unique(np.concatenate(self.sets))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scan(self, grams: np.ndarray) -> dict[int, tuple[float, int]]:
        """Template -> (containment, first word of the window)."""
        at = np.flatnonzero(self.maybe[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(grams[at], self.all)]
        found: dict[int, tuple[float, int]] = {}
        for size in self.classes if len(at) else ():
            starts = np.unique(np.concatenate([at // size, at // size - 1])) * size
            for a in starts[starts >= 0].tolist():
                window = np.unique(grams[a : a + 2 * size - GRAM + 1])
                if not len(window):
                    continue
                met = {i for band, v in zip(self.bands[size], self.hashes.signature(window).tolist(), strict=True) for i in band.get(v, ())}
                for i in met:
                    share = float(np.isin(self.sets[i], window, assume_unique=True).mean())
                    if share >= self.threshold - 1e-12 and (i not in found or share > found[i][0]):
                        found[i] = (share, a)
        return found


def _scan(templates: dict[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            for i, j in _words.slices(batch.column("text")):
                h, rows, *_ = _words.words(batch.column("text").slice(i, j - i))
                at, out = [], []
                for k, grams in enumerate(_words.shingles(h, rows, GRAM)):
                    if rows[k + 1] - rows[k] >= GRAM:
                        for t, (share, first) in sorted(scanner.scan(grams).items()):
                            at.append(i + k)
                            out.append((scanner.names[t], share, first))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], ["doc_id", "license", "containment", "first_word"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, license, containment, first_word) of docs (doc_id, text)."""
    python_ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(templates, threshold), f"doc_id {kind}, license string, containment double, first_word long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
