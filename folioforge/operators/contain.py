"""Which texts hold which others: a containment join of two large sides.

Of every run of WINDOW bytes, the gram (GRAM bytes) with the least hash is picked.
A text that holds another holds all of its runs, hence all its picked grams; so
the other text is looked for by its rarest picked gram only, and candidates are
verified on the whole texts.  Sought texts of LONG_WINDOW bytes or more go by grams
of LONG_GRAM bytes, which few texts have that don't hold them.  Exact for texts of
WINDOW bytes or more; shorter ones are compared within their join keys.

Of a sought text KEPT grams, which few other sought ones have, are counted in the
texts; the join keys are part of a gram.  A bitmap of a fixed size leaves nearly all
other grams out where texts are read, so what is shuffled and written grows with the
sought side and its hits, not with the text.  Equal sought texts count once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.sources.scratch import written

GRAM, WINDOW = 8, 12
LONG_GRAM, LONG_WINDOW = 24, 36
#: Grams of a sought text that are compared with those of other sought ones, and that are looked for.
TRIED, KEPT = 16, 4
BITS = 1 << 25
#: Text that a worker looks at together.
SLICE = 2 << 20
#: Candidates that may be sent to the texts at once, and passes over the texts for more; beyond, they meet by a shuffle.
SENT, PASSES = 64 << 20, 3
#: A key with more than one in HOT of all rows is hot; fewer than HOT keys can be.
HOT = 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    # odd factors and shifts can be undone, so different numbers stay different
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def picked_grams(data: np.ndarray, ends: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the picked grams of texts that stand one after another in
    ``data``; ``ends``: where each ends.  Of eight bytes the hash tells grams apart."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    h = part = _mixed(grams)
    for at in range(8, gram, 8):
        h = _mixed(h[: len(part) - at]) + part[at:]
    least, size, most = h.view(np.int64), 1, window - gram + 1
    while size < most:  # the least of runs of twice the length, and at last of the window's
        step = min(size, most - size)
        least, size = np.minimum(least[: len(least) - step], least[step:]), size + step
    least = least[:n]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    inside = ends[text] - np.arange(n) >= window
    text, least = text[inside], least[inside]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    return text[new], least[new]


def _grams(bits: object = None, short: bool = True):
    """Rows (key, gram) of (space, key, text); a gram's number has the space in it.

    Without ``bits``: at most TRIED grams of a sought text, of the kind that its
    length asks for.  With ``bits``: all that are in them, of the long kind and,
    with ``short``, of the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy())
            cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(SLICE, size[-1] if len(size) else 0, SLICE)) + 1, [b.num_rows]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = b.slice(lo, hi - lo)
                lens = pc.fill_null(pc.binary_length(part.column(2)), 0).to_numpy()
                data = np.frombuffer("".join(t or "" for t in part.column(2).to_pylist()).encode(), np.uint8)
                space, found = part.column(0).to_numpy().view(np.uint64), []
                for kind in ((LONG_GRAM, LONG_WINDOW), (GRAM, WINDOW))[: 1 + short]:
                    text, gram = picked_grams(data, np.cumsum(lens), *kind)
                    gram = _mixed(gram.view(np.uint64) ^ space[text]).view(np.int64)
                    if bits is not None:
                        at = gram & (BITS - 1)
                        own = ((bits.value[at >> 6] >> (at & 63)) & 1) == 1
                    else:
                        own = (lens[text] >= LONG_WINDOW) == (kind[1] == LONG_WINDOW)
                    found.append((text[own], gram[own]))
                text, gram = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
                text, gram = text[new], gram[new]
                if bits is None:
                    few = np.arange(len(text)) - np.searchsorted(text, text) < TRIED
                    text, gram = text[few], gram[few]
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(text)), pa.array(gram)], ["key", "gram"])

    return run


def _bits(grams: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits; the driver gets its words that are not zero."""
    at = F.pmod("gram", F.lit(BITS))
    words = grams.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    out = np.zeros(BITS // 64, np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def join_hot(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; ``side`` has n_rows, how many of ``rows`` have its keys.

    Keys with more than one in HOT of all these rows are few, so they are
    gathered; their entries are sent to the rows, the others meet by a shuffle.
    """
    total = side.agg(F.sum("n_rows")).first()[0] or 0
    h = F.xxhash64(*keys)
    hot = [r.h for r in side.where(F.col("n_rows") * HOT > max(total, 100 * HOT)).select(h.alias("h")).distinct().collect()]
    if not hot:
        return rows.join(side.drop("n_rows"), list(keys))
    is_hot = h.isin(hot)
    return rows.where(is_hot).join(F.broadcast(side.where(is_hot).drop("n_rows")), list(keys)).unionByName(rows.where(~is_hot).join(side.where(~is_hot).drop("n_rows"), list(keys)))


def contained(sought: DataFrame, texts: DataFrame, on: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(on, form, carry) for every ``texts`` row whose text holds a sought form.

    ``sought``: on, form.  ``texts``: on, carry, text.  The ``on`` columns must be
    equal (null equals nothing).  Empty and null forms are found nowhere; forms
    of less than WINDOW bytes are compared with all texts of equal ``on``, and
    without such columns they are refused.  Rows of ``texts`` are separate,
    however often they repeat; equal sought rows give one result.
    """
    on, carry = list(on), list(carry)
    # of null keys nothing can be found
    some = F.lit(True)
    for c in on:
        some = some & F.col(c).isNotNull()
    wanted = written(sought.where(some & (F.col("form") != "")).select(*on, "form").distinct(), "contain-sought")
    long = wanted.where(F.octet_length("form") >= WINDOW)
    short = wanted.where(F.octet_length("form") < WINDOW)
    named = [F.col(c).cast("string") for c in on]
    space = F.xxhash64(F.lit(0), *named).alias("space")
    # the key of a sought text is its digest, so that it travels only where it is verified
    mark = F.unhex(F.md5(F.concat_ws("\x1f", *named, "form")))
    own = written(long.select(space, mark.alias("key"), "form").mapInArrow(_grams(), "key binary, gram long"), "contain-grams")
    shared = own.groupBy("gram").agg(F.count("*").alias("n"))
    few = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, KEPT).getField("gram")  # of TRIED at most
    own = written(own.join(shared, "gram").groupBy("key").agg(few.alias("gram")).select("key", F.explode("gram").alias("gram")), "contain-kept")
    bits = texts.sparkSession.sparkContext.broadcast(_bits(own.select("gram")))
    with_short = not wanted.where(F.octet_length("form").between(WINDOW, LONG_WINDOW - 1)).isEmpty()
    # texts whose keys agree by chance are looked at together, each as a whole
    text_key = F.xxhash64(*named, "text").alias("key")
    held = texts.where(some).select(space, text_key, "text").mapInArrow(_grams(bits, with_short), "key long, gram long")
    held = written(held.groupBy("key", "gram").agg(F.count("*").alias("copies")), "contain-held")
    df = held.groupBy("gram").agg(F.count("*").alias("n_rows"))
    # a sought text of which one gram is nowhere is nowhere itself
    rarest = own.join(df, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n_rows", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    rarest = rarest.select(F.col("key").alias("sought"), "x.gram", F.col("x.n").alias("n_rows"))
    of_gram = rarest.groupBy("gram").agg(F.collect_list("sought").alias("of"), F.max("n_rows").alias("n_rows"))
    pairs = join_hot(held, written(of_gram, "contain-rarest"), ["gram"]).select("key", "copies", F.explode("of").alias("sought"))
    forms = long.select(*on, mark.alias("sought"), "form")
    asked = pairs.join(forms, "sought").groupBy(*on, "key").agg(F.collect_list("form").alias("forms"), F.max("copies").alias("n_rows"))
    asked = written(asked, "contain-candidates")
    rows = texts.where(some).select(*on, *carry, "text", text_key)
    size = asked.agg(F.sum(F.octet_length(F.array_join("forms", "")) + 64)).first()[0] or 0
    at = [*on, "key"]
    if size > PASSES * SENT:
        met = join_hot(rows, asked, at)
    else:
        n, met = max(1, -(-size // max(SENT, 1))), None
        for i in range(n):
            part = rows.join(F.broadcast(asked.where(F.pmod("key", F.lit(n)) == i).drop("n_rows")), at)
            met = part if met is None else met.unionByName(part)
    out = met.select(*on, *carry, F.explode(F.filter("forms", lambda f: F.contains(F.col("text"), f))).alias("form"))
    least = short.agg(F.sum(F.octet_length("form") + 64)).first()[0] or 0
    if not least:
        return out.select(*on, "form", *carry)
    if not on:
        raise ValueError(f"without join keys sought texts have {WINDOW} bytes or more")
    near = texts.select(*on, *carry, "text").join(F.broadcast(short) if least <= SENT else short, on).where(F.contains("text", "form"))
    return out.select(*on, "form", *carry).unionByName(near.select(*on, "form", *carry))
