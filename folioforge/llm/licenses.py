"""License scan: an exact set-similarity join of text blocks and templates.

A block is a window of the document's words; a template of at most half a window's
words lies whole in one of the windows, which overlap by half.  Block and template
are sets of words.  Template T is contained in block B if |T and B| is at least
THRESHOLD per cent of |T|.  The join is exact:

* words have a global order, rarest in the whole corpus first;
* prefix filter: of |T| - a + 1 rarest words of T (a: the words that must be
  shared) one must be in B, among the first |B| - a + 1 words of B;
* length filter: B has at least a words that occur in templates;
* positional filter: words shared so far plus what can still follow in T and in B
  must reach a;
* what is left is verified on the full sets.

Words of no template cannot be shared; a block is kept without them.  Documents
are tokenised once; the narrow rows of their blocks are written, the word
counts of all documents are summed from them, and a second pass joins.  No text
is shuffled; the templates, of a checked size, are sent to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import LOWER, bytes_of, lists, words_of
from .common import materialize, text_slices

THRESHOLD = 85
#: Words of a window; a template goes to the first that is twice its length or more.
WINDOWS = (32, 128, 512)
MOST_TEMPLATE_BYTES = 4 << 20
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` on lower-cased bytes: digits, a-z and all that is not ASCII.
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

# Phrases and labels of the base rule.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License"

# Fixed values: (family, label, notice), the usual public notices of the licenses.
TEMPLATES = (
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "This project is licensed under the terms of the MIT license"),
    (
        "mit",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gpl-2", _GPL.format("General Public License", 2)),
    ("gpl", "gpl-3", _GPL.format("General Public License", 3)),
    ("gpl", "lgpl-3", _GPL.format("Lesser General Public License", 3)),
    ("gpl", "agpl-3", _GPL.format("Affero General Public License", 3)),
    ("bsd", "bsd-2", _BSD),
    ("bsd", "bsd-3", _BSD + _NAMES),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc", "cc-by", "Licensed under CC BY 4.0"),
    ("cc", "cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc", "cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc", "cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc", "cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc", "cc-by", _CC.format("Attribution")),
    ("cc", "cc-by-sa", _CC.format("Attribution-ShareAlike")),
    ("cc", "cc-by-nc", _CC.format("Attribution-NonCommercial")),
    ("cc", "cc-by-nd", _CC.format("Attribution-NoDerivatives")),
    ("cc", "cc-by-nc-sa", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("cc", "cc-by-nc-nd", _CC.format("Attribution-NonCommercial-NoDerivatives")),
    ("cc", "cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
)


def words(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    found = words_of(data, IS_WORD, np.zeros(1, np.int64))
    distinct = [w.decode() for w in found.distinct.to_pylist()]
    return [distinct[c] for c in found.code]


@dataclass
class Template:
    family: str
    label: str
    words: frozenset[str]
    window: int
    least: int  # words that must be shared


def compiled(templates, threshold: int) -> list[Template]:
    if sum(len(x[2].encode()) for x in templates) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_BYTES} bytes; scan them in several calls")
    out = []
    for family, label, notice in templates:
        listed = words(notice)
        window = next((w for w in WINDOWS if 2 * len(listed) <= w), None)
        if not listed or window is None:
            raise ValueError(f"a template has 1 to {WINDOWS[-1] // 2} words: {notice[:60]!r}")
        distinct = frozenset(listed)
        out.append(Template(family, label, distinct, window, -(-threshold * len(distinct) // 100)))
    return out


# first pass: documents as sets of words ----------------------------------------


class Reader:
    """Counts, base phrases and blocks of a batch of texts."""

    def __init__(self, templates: list[Template], phrases):
        self.phrases = [(label, words(p)) for label, p in phrases]
        self.vocabulary = sorted({w for t in templates for w in t.words} | {w for _, p in self.phrases for w in p})
        self.id_of = {w.encode(): i for i, w in enumerate(self.vocabulary)}
        self.windows = sorted({t.window for t in templates})
        #: of each window size: which words its templates have, the fewest words that a block needs
        self.of_window = []
        for size in self.windows:
            own = [t for t in templates if t.window == size]
            used = np.zeros(len(self.vocabulary), bool)
            used[[self.id_of[w.encode()] for t in own for w in t.words]] = True
            self.of_window.append((size, used, min(t.least for t in own)))

    def read(self, texts: pa.Array) -> list[pa.Array]:
        data, at = bytes_of(texts)
        found = words_of(LOWER[data], IS_WORD, at)
        known = np.array([self.id_of.get(w, -1) for w in found.distinct.to_pylist()], np.int64)
        ids = known[found.code] if len(found.code) else np.zeros(0, np.int64)
        first = np.searchsorted(found.start, at)  # first word of each text, and the end
        w0, w1 = first[:-1], first[1:]
        n, rows = w1 - w0, len(texts)
        doc = np.repeat(np.arange(rows), n)
        hits, labels = self._phrases(ids, doc, w1)
        order = np.sort(hits)
        lo, hi = np.searchsorted(order, w0), np.searchsorted(order, w1)
        none = lo == hi
        ends = np.append(order, 0)
        first_word, last_word = (pa.array(np.where(none, 0, ends[np.where(none, 0, k)] - w0).astype(np.int64), mask=none) for k in (lo, hi - 1))
        placed = np.flatnonzero(ids >= 0)
        tokens, counts = np.unique(doc[placed] * len(self.vocabulary) + ids[placed], return_counts=True)
        per_doc = np.bincount(tokens // len(self.vocabulary), minlength=rows)
        return [
            pa.array(n.astype(np.int64)), pa.array((hi - lo).astype(np.int64)), first_word, last_word, labels,
            lists(pa.array((tokens % len(self.vocabulary)).astype(np.int32)), per_doc), lists(pa.array(counts.astype(np.int32)), per_doc),
            self._blocks(ids, doc, w0, n),
        ]

    def _phrases(self, ids: np.ndarray, doc: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Words at which a phrase begins (once per phrase), and the labels of each text."""
        hits, have = [], {}
        for label, phrase in self.phrases:
            wanted = [self.id_of[w.encode()] for w in phrase]
            places = np.flatnonzero(ids == wanted[0])
            places = places[places + len(wanted) <= w1[doc[places]]]
            for k, w in enumerate(wanted[1:], 1):
                places = places[ids[places + k] == w]
            hits.append(places)
            for d in np.unique(doc[places]).tolist():
                have.setdefault(d, set()).add(label)
        out = [sorted(have.get(d, ())) for d in range(len(w1))]
        return np.concatenate(hits) if hits else np.zeros(0, np.int64), pa.array(out, pa.list_(pa.string()))

    def _blocks(self, ids: np.ndarray, doc: np.ndarray, w0: np.ndarray, n: np.ndarray) -> pa.Array:
        """Blocks (window, block, tokens) of each text with enough words of templates."""
        rows, v, kinds = len(w0), len(self.vocabulary), len(self.windows)
        half = np.array(self.windows, np.int64) // 2
        n_blocks = np.where(n[:, None] > 0, np.maximum(1, -(-n[:, None] // half[None, :]) - 1), 0).astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(n_blocks.ravel())])
        keys = []
        for k, (_, used, _) in enumerate(self.of_window):
            at = np.flatnonzero(np.append(used, False)[ids])
            block = (at - w0[doc[at]]) // half[k]
            base = offset[doc[at] * kinds + k]
            for b in (block, block - 1):
                inside = (b >= 0) & (b < n_blocks[doc[at], k])
                keys.append((base + b)[inside] * v + ids[at][inside])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        block = keys // v
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        held = block[starts]
        pair = np.searchsorted(offset, held, "right") - 1  # document and kind of window
        enough = sizes >= np.array([least for *_, least in self.of_window])[pair % kinds] if len(held) else np.zeros(0, bool)
        keys = keys[np.repeat(enough, sizes)]
        held, pair, sizes = held[enough], pair[enough], sizes[enough]
        fields = {"window": pa.array(np.array(self.windows, np.int32)[pair % kinds]), "block": pa.array((held - offset[pair]).astype(np.int64)), "tokens": lists(pa.array((keys % v).astype(np.int32)), sizes)}
        return lists(pa.StructArray.from_arrays(list(fields.values()), list(fields)), np.bincount(pair // kinds, minlength=rows))


# second pass: the join ----------------------------------------------------------


class Index:
    """Inverted index of the templates' prefixes in the global order of words."""

    def __init__(self, templates: list[Template], vocabulary: list[str], counts: dict[int, int]):
        order = sorted(range(len(vocabulary)), key=lambda i: (counts.get(i, 0), vocabulary[i]))
        self.rank = np.empty(len(vocabulary), np.int64)
        self.rank[order] = np.arange(len(vocabulary))
        id_of = {w: i for i, w in enumerate(vocabulary)}
        self.templates = templates
        self.sets = [frozenset(int(self.rank[id_of[w]]) for w in t.words) for t in templates]
        self.postings: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.leads = {w: np.zeros(len(vocabulary), bool) for w in {t.window for t in templates}}
        for k, t in enumerate(templates):
            for place, r in enumerate(sorted(self.sets[k])[: len(t.words) - t.least + 1]):
                self.postings.setdefault((t.window, r), []).append((k, place))
                self.leads[t.window][r] = True

    def match(self, window: int, ranks: list[int]) -> list[tuple[int, int]]:
        """(template, shared words) of all templates that a block contains; its
        words are given by ascending rank."""
        shared: dict[int, int] = {}
        for at, r in enumerate(ranks):
            for k, place in self.postings.get((window, r), ()):
                least, size = self.templates[k].least, len(self.sets[k])
                if at > len(ranks) - least:  # length filter and the block's own prefix
                    continue
                so_far = shared.get(k, 0)
                if so_far >= 0:
                    shared[k] = so_far + 1 if so_far + 1 + min(size - place - 1, len(ranks) - at - 1) >= least else -1
        have = set(ranks)
        verified = ((k, len(self.sets[k] & have)) for k, c in shared.items() if c > 0)
        return sorted((k, c) for k, c in verified if c >= self.templates[k].least)

    def decided(self, found: list[tuple[int, int]]) -> set[int]:
        """Of each family the variant that fits best, then the one that says more;
        where different ones fit equally well none."""
        best: dict[str, list] = {}
        for k, c in found:
            t = self.templates[k]
            best.setdefault(t.family, []).append((c / len(t.words), len(t.words), t.label, k))
        out = set()
        for fits in best.values():
            top = max(f[:2] for f in fits)
            tied = [f for f in fits if f[:2] == top]
            if len({f[2] for f in tied}) == 1:
                out |= {f[3] for f in tied}
        return out


MATCH = "struct<family:string,label:string,window:int,block:long,shared:int,share:double,decides:boolean>"


def _joined(blocks: pa.Array, index: Index) -> pa.Array:
    """Matches of each row's blocks."""
    flat, rows = blocks.flatten(), len(blocks)
    out: list[list[dict]] = [[] for _ in range(rows)]
    row_of = np.repeat(np.arange(rows), np.diff(blocks.offsets.to_numpy()))
    window, number, tokens = (flat.field(k) for k in range(3))
    window, at = window.to_numpy(), tokens.offsets.to_numpy()
    ranks = index.rank[tokens.flatten().to_numpy()]
    at = at - at[0]
    for size, leads in index.leads.items():
        own = np.flatnonzero(window == size)
        if not len(own):
            continue
        lead = np.concatenate([[0], np.cumsum(leads[ranks])])
        for b in own[lead[at[own + 1]] > lead[at[own]]].tolist():
            found = index.match(size, np.sort(ranks[at[b] : at[b + 1]]).tolist())
            decided = index.decided(found)
            for k, c in found:
                t = index.templates[k]
                out[row_of[b]].append({"family": t.family, "label": t.label, "window": size, "block": number[b].as_py(), "shared": c, "share": c / len(t.words), "decides": k in decided})
    kinds = [("family", pa.string()), ("label", pa.string()), ("window", pa.int32()), ("block", pa.int64()), ("shared", pa.int32()), ("share", pa.float64()), ("decides", pa.bool_())]
    return pa.array(out, pa.list_(pa.struct(kinds)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and every block that contains a template.

    Columns: doc_id, n_words, n_base (places of phrases), first_word, last_word
    (smallest and largest start, else null), base_labels, labels (with those of
    deciding matches; both distinct and sorted), score (1 with a phrase, else the
    largest share, else 0), matches array<struct<family, label, window, block,
    shared, share, decides>>: block k of a window of w words covers words k * w/2
    to k * w/2 + w of the document.  All matches are listed; of variants of one
    family in one block the best decides.  Null text = empty text without words.
    Rows are independent: repeated rows give equal results, an empty table an
    empty one.  ``templates``: (family, label, notice), at most MOST_TEMPLATE_BYTES
    in all, else ValueError.
    """
    known = compiled(templates, threshold)
    reader = Reader(known, phrases)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, tokens array<int>, counts array<int>, blocks array<struct<window:int,block:long,tokens:array<int>>>"
    names = [f.name for f in docs.sparkSession.createDataFrame([], schema).schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), *reader.read(b.column(1))], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(picked.mapInArrow(read, schema), "license-blocks")
    each = blocks.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum(F.col("x.counts").cast("long")).alias("n"))
    index = Index(known, reader.vocabulary, {r.token: r.n for r in each.collect()})  # at most one row per word of the templates
    kept = names[:6]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:6], _joined(b.column(6), index)], [*kept, "matches"])

    found = blocks.select(*kept, "blocks").mapInArrow(join, f"{', '.join(schema.split(', ')[:6])}, matches array<{MATCH}>")
    decided = F.transform(F.filter("matches", lambda m: m["decides"]), lambda m: m["label"])
    share = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        *kept, F.array_sort(F.array_union("base_labels", decided)).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"), "matches"
    )
