"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

Templates are grouped by the size of their shingle set (powers of two). For a group with largest size u a text is cut in windows
of 2u shingles, one every u, so any run of u shingles lies whole in one of them. A window that holds `PERCENT` of a template of
n shingles has a Jaccard similarity with it of at least s = t n / (2u + n - t n), t = PERCENT / 100. With bands of one row, b bands miss it with
probability (1 - s)^b; b is chosen for each group so that this is at most `MISS`. Windows without any template shingle
can't share a band value with a template and get no signature. Candidates are verified: a window matches if it holds `PERCENT` of the
template's shingles.

A shingle is five words (runs of bytes between ASCII white space, A-Z lower-cased), or the whole template where it has fewer.

Defined results: null, empty and blank texts match nothing; a template is reported once for each row of the input, with the most
shingles a window holds; repeated rows are reported each; blank templates never match; an empty table gives no rows; other
columns are neither read nor clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import Words, as_bytes, chunks, mix, shingle_hashes
from qaloom.llm.contamination import _LOWER, _SQL_UPPER

SHINGLE = 5
PERCENT = 80
MISS = 1e-9

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bands(n: int, u: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Bands of one row that miss a window holding `percent` of n shingles, in 2u, with probability `miss` at most."""
    t = percent / 100
    s = t * n / (2 * u + n - t * n)
    return math.ceil(math.log(miss) / math.log(1 - min(s, 1 - 1e-9)))


class Group:
    """Templates of one size class, with the MinHash signature of each."""

    def __init__(self, u: int, names: list[str], sets: list[np.ndarray]):
        self.u, self.names, self.sets = u, names, sets
        self.seeds = mix(np.arange(1, bands(min(map(len, sets)), u) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.signatures = [self.signature(s) for s in sets]
        self.known = np.unique(np.concatenate(sets))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return mix(shingles[None, :] ^ self.seeds[:, None]).min(axis=1)

    def find(self, shingles: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, shared shingles) for all windows of a text that match; hit: positions of shingles of any template."""
        some = hit[np.isin(shingles[hit], self.known)]
        windows = np.unique(np.concatenate([some // self.u, some // self.u - 1]))
        for i in windows[windows >= 0].tolist():
            held = np.unique(shingles[i * self.u : i * self.u + 2 * self.u])
            mine = self.signature(held)
            for j, s in enumerate(self.sets):
                if (mine == self.signatures[j]).any():
                    shared = int(np.isin(s, held).sum())
                    if shared * 100 >= PERCENT * len(s):
                        yield j, shared


def groups_of(templates: dict[str, str], k: int = SHINGLE) -> list[Group]:
    by_size: dict[int, tuple[list[str], list[np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        w = Words([text.encode()], lower=True)
        h, _ = shingle_hashes(w.hashes(), w.first, k)
        if len(h):
            s = np.unique(h)
            names, sets = by_size.setdefault(1 << (len(h) - 1).bit_length(), ([], []))
            names.append(name)
            sets.append(s)
    return [Group(u, *by_size[u]) for u in sorted(by_size)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, license, n_shingles, shared) for every template that a text holds."""
    groups = groups_of(TEMPLATES if templates is None else templates, k)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = np.unique(np.concatenate([g.known for g in groups])) if groups else np.zeros(0, np.uint64)
        for b in batches:
            names, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            rows = []
            for lo, hi in chunks([len(t) for t in texts]):
                w = Words(texts[lo:hi], lower=True)
                h, bounds = shingle_hashes(w.hashes(), w.first, k)
                at = np.flatnonzero(np.isin(h, known))
                first = np.searchsorted(at, bounds)
                for i in np.flatnonzero(np.diff(first)).tolist():
                    shingles, hit = h[bounds[i] : bounds[i + 1]], at[first[i] : first[i + 1]] - bounds[i]
                    best: dict[tuple[str, int], int] = {}
                    for g in groups:
                        for j, shared in g.find(shingles, hit):
                            key = (g.names[j], len(g.sets[j]))
                            best[key] = max(shared, best.get(key, 0))
                    rows += [(names[lo + i], name, n, shared) for (name, n), shared in best.items()]
            if rows:
                ids, licenses, n, shared = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(licenses), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], names=["doc_id", "license", "n_shingles", "shared"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, "doc_id long, license string, n_shingles long, shared long")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    from qaloom.session import table

    return scan(table(spark, sf_dir, "documents"))


def _check() -> str:
    values = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES.items())
    split = f"[x FOR x IN string_split(translate(text, {_SQL_UPPER}, '{_LOWER}'), ' ') IF x <> '']"
    shingles = """CASE WHEN len(w) >= 5 THEN [{'p': i - 1, 's': array_to_string(w[i:i + 4], ' ')} FOR i IN range(1, len(w) - 3)]
        WHEN len(w) > 0 THEN [{'p': 0, 's': array_to_string(w, ' ')}] ELSE [] END"""
    return f"""
WITH t AS (SELECT license, unnest({shingles}) AS x FROM (SELECT license, {split} AS w FROM (VALUES {values}) v(license, text))),
n AS (SELECT license, count(DISTINCT x.s) AS n_shingles, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS u FROM t GROUP BY license),
d AS (SELECT doc_id, unnest({shingles}) AS x FROM (SELECT doc_id, {split} AS w FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, license, n_shingles, t.x.s AS s, unnest([d.x.p // u, d.x.p // u - 1]) AS i
      FROM d JOIN (SELECT DISTINCT license, x FROM t) t ON d.x.s = t.x.s JOIN n USING (license)),
c AS (SELECT doc_id, license, n_shingles, i, count(DISTINCT s) AS shared FROM h WHERE i >= 0 GROUP BY ALL)
SELECT doc_id, license, n_shingles, max(shared) AS shared FROM c WHERE shared * 100 >= n_shingles * {PERCENT} GROUP BY doc_id, license, n_shingles
"""


QUERIES = {"op9_license_scan": op9_license_scan}
CHECKS = {"op9_license_scan": _check()}
