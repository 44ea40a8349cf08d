"""BPE encoding and decoding; long unsplit text by tree concatenation.

Ordinary text falls into pieces that are encoded independently, so a piece is
encoded once and remembered.  A piece that the pre-tokenizer does not split and
that is longer than ``leaf`` code points (a run of letters, say) is cut into
leaves, the leaves are encoded in parallel (by threads: the library gives up the
interpreter's lock while it encodes), and neighbours are joined pairwise up a
tree, the joins of a level side by side.  A join re-encodes a window around the seam and accepts it only when
the window starts with a token of the left side and ends with a token of the
right side; otherwise the window grows.

Why agreement is enough: a sequence of merges of byte-pair encoding is the
encoding of its text exactly when every two neighbouring tokens are the encoding
of theirs.  Sharing one token at each end makes every neighbouring pair of the
joined sequence a pair of some correct encoding.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

LEAF = 2048
WINDOW = 8
#: Threads over the leaves of one long piece, and leaves from which they are used.
THREADS, MANY_LEAVES = 4, 8
#: Pieces remembered by one worker; beyond that it starts anew.
REMEMBERED = 100_000
#: Text of a slice, and pieces that go to the library together, which answers with
#: hundreds of bytes each.
SLICE_BYTES, TOGETHER = 1 << 20, 20_000

#: A space with a plain character on either side: pre-tokens begin at such a
#: space and nothing before it looks past it.  Other white space is left alone.
CUT = re.compile("(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BpeCodec:
    """Encoder and decoder over one byte-level BPE file."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.path = path
        self.leaf, self.window = leaf, window
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special_cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.unsplit = re.compile(rf"(?<!\S)\S{{{leaf},}}+|(?<!\s)\s{{{leaf},}}+")
        self.memory: dict[str, tuple[int, ...]] = {}
        self.bytes_of = self._token_bytes()

    @cached_property
    def raw(self):
        """The same merges without splitting; only long unsplit text needs it."""
        from tokenizers import Tokenizer, pre_tokenizers

        raw = Tokenizer.from_file(self.path)
        raw.no_truncation()
        raw.no_padding()
        raw.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return raw

    def _token_bytes(self) -> list[bytes]:
        # the byte alphabet of byte-level BPE: printable bytes stand for
        # themselves, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        to_byte = {chr(b): b for b in plain}
        to_byte |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        out = [b""] * self.whole.get_vocab_size(with_added_tokens=True)
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            out[i] = token.encode("utf-8") if token in self.special else bytes(to_byte[c] for c in token)
        return out

    # encoding ---------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """The ids that ``tokenizers`` gives without added special tokens."""
        if self.unsplit.search(text):
            return self._encode_long(text)
        out: list[int] = []
        memory = self.memory
        pieces = CUT.split(text)
        for p in pieces:
            ids = memory.get(p)
            if ids is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                ids = tuple(self.whole.encode(p, add_special_tokens=False).ids)
                if len(p) <= 64:
                    memory[p] = ids
            out += ids
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """As :meth:`encode`; pieces that are new go to the library together."""
        memory, new = self.memory, {}
        if len(memory) >= REMEMBERED:
            memory.clear()
        cut = []
        for text in texts:
            pieces = None if self.unsplit.search(text) else CUT.split(text)
            cut.append(pieces)
            if pieces:
                new.update(dict.fromkeys(p for p in pieces if p not in memory))
        fresh = list(new)
        for i in range(0, len(fresh), TOGETHER):
            part = fresh[i : i + TOGETHER]
            for p, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False)):
                memory[p] = tuple(e.ids)
        out = []
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self._encode_long(text))
            else:
                ids: list[int] = []
                for p in pieces:
                    ids += memory[p]
                out.append(ids)
        for p in fresh:
            if len(p) > 64:
                del memory[p]
        return out

    def _encode_long(self, text: str) -> list[int]:
        """Text with an unsplit piece of ``leaf`` code points or more."""
        out: list[int] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            pieces = [text_ for text_ in self._pre_tokens(part)]
            short = [p for p in pieces if len(p) < self.leaf]
            ids = {p: e.ids for p, e in zip(short, self.raw.encode_batch_fast(short, add_special_tokens=False))}
            for p in pieces:
                out += ids[p] if len(p) < self.leaf else self.encode_unsplit(p)
        return out

    def _pre_tokens(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def encode_unsplit(self, piece: str) -> list[int]:
        """Tree concatenation over one pre-token; its parts in parallel."""
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        if len(leaves) < MANY_LEAVES:
            return self._tree(leaves, map)
        with ThreadPoolExecutor(THREADS) as pool:
            return self._tree(leaves, pool.map)

    def _tree(self, leaves: list[str], each) -> list[int]:
        level = list(each(self._leaf, leaves))
        while len(level) > 1:
            joined = list(each(self.join, level[::2], level[1::2]))
            level = joined + level[2 * len(joined) :]
        return list(level[0]) if level else []

    def _leaf(self, text: str) -> list[int]:
        return self.raw.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts together, given the encoding of each."""
        if not left or not right:
            return [*left, *right]
        n = self.window
        while True:
            a, b = left[-n:], right[:n]
            window = self._encode_bytes(b"".join(self.bytes_of[i] for i in (*a, *b)))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if window is not None and (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return [*left[: len(left) - len(a)], *window, *right[len(b) :]]
            if whole_left and whole_right:
                raise ValueError("the joined text is not valid UTF-8")
            n *= 2

    def _encode_bytes(self, data: bytes) -> list[int] | None:
        """None where the window cuts a character."""
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return None
        return self.raw.encode(text, add_special_tokens=False).ids

    # decoding ---------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def codec(path: str, leaf: int = LEAF) -> BpeCodec:
    return BpeCodec(path, leaf)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, digests: bool = False, leaf: int = LEAF) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Columns: doc_id, n_tokens, and ids array<int> plus decoded (``with_ids``),
    and ids_sha256 (of the decimal ids joined by commas) plus decoded_sha256
    (``digests``).  A null or empty text has no tokens and decodes to the empty
    text.  The strings of special tokens inside a text become their ids, as in
    the library.  Texts of any length are encoded whole.  Rows are independent,
    so repeated rows and ids give repeated results; no row is shuffled.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, n_tokens long" + ", ids array<int>, decoded string" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, leaf)
        decimal = [str(i).encode() for i in range(len(bpe.bytes_of))]
        sha = hashlib.sha256
        for b in text_slices(batches, 1, SLICE_BYTES):
            all_ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            cols = [b.column(0).cast(pa.int64()), pa.array(map(len, all_ids), pa.int64())]
            decoded = [bpe.decode(ids) for ids in all_ids]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            if digests:
                cols += [
                    pa.array([sha(b",".join(map(decimal.__getitem__, ids))).hexdigest() for ids in all_ids]),
                    pa.array([sha(d.encode("utf-8")).hexdigest() for d in decoded]),
                ]
            yield pa.RecordBatch.from_arrays(cols, names)
        bpe.memory.clear()  # a worker outlives its task

    names = [f.split()[0] for f in schema.replace("array<int>", "x").split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

