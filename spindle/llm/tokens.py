"""Token counts from pre-token frequencies, and the tokenizer files' fast paths.

The vocabulary files' pre-tokenizers cut a text into pieces that are encoded one by one, so a document's count is the sum
over its distinct pieces of frequency times the piece's tokens. Each distinct piece of the corpus is encoded once, and no
list of ids is kept. The HEAD most frequent pieces, a table of fixed size, are counted first and broadcast; their part of
a document is summed where it is read. The other pieces are dealt by name with the documents' frequencies: each is
counted by the task that has all its rows, and the products go back to their documents. A piece that is dealt is none
of the most frequent, so none has more than a small share of the rows.

Texts with characters outside a plain set, in which Python's and the library's character classes could differ, are cut
by the library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, tidy

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A character for which the fast path would not be certain.
ODD = re.compile(f"[^\\t\\n\\r -~{LETTERS}]")
#: The pieces of byte_bpe_50k.json and of word_bpe_49k.json, over the plain set.
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: The pieces of words, one word a line; where a text's pieces are the library's business.
LINES, UNSURE = re.compile(WORD_PIECES.pattern + r"|\n"), ODD.pattern + r"|<\|"
#: Chunks that a task remembers; words that a worker does; pieces that are broadcast.
MOST, WORDS, HEAD = 100_000, 300_000, 1 << 18


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Cutter:
    """Cuts texts into pre-tokens: pieces that the library encodes one by one. A special string is a piece of its own."""

    def __init__(self, path: str):
        self.tok = load(path)
        kept = json.loads(self.tok.to_str())
        before, added = kept.get("pre_tokenizer") or {}, list(self.tok.get_added_tokens_decoder().values())
        #: Other files' rules are not known here: a whole text is one piece then.
        self.known = kept.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.special = re.compile("(" + "|".join(sorted((re.escape(t.content) for t in added), key=len, reverse=True)) + ")") if added else None

    def plain(self, text: str) -> bool:
        return self.known and not ODD.search(text) and not (self.special and self.special.search(text))

    def pieces(self, text: str) -> list[str]:
        if not self.known:
            return [text] if text else []
        if self.plain(text):
            return BYTE_PIECES.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            out += [part] if k % 2 else [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def chunks(self, text: str) -> list[str] | None:
        """Space-delimited chunks, of which pieces() gives the text's pieces; None where spaces may not part pieces."""
        if not self.plain(text) or "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or text[:1].isspace() or text[-1:].isspace():
            return None
        # A piece never holds a non-space and then a space, so such places always divide pieces.
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]

    def sizes(self, pieces: list[str]) -> list[int]:
        return list(map(len, self.tok.encode_batch_fast(pieces, add_special_tokens=False)))


PIECE = pa.schema([("piece", pa.string()), ("n", pa.int64())])


def piece_counter(path: str, least: int = 3):
    """Texts -> pieces with how often they were met, those met least times in a stretch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, chunks, pieces = Cutter(path), Counter(), Counter()

        def melt() -> None:
            for c, n in chunks.items():
                for p in BYTE_PIECES.findall(c):
                    pieces[p] += n
            chunks.clear()

        def out() -> pa.RecordBatch:
            kept = [(p, n) for p, n in pieces.items() if n >= least]
            pieces.clear()
            return batch(PIECE, [[p for p, _ in kept], [n for _, n in kept]])

        for b in batches:
            for at in range(0, b.num_rows, 500):
                for t in b.column(0).slice(at, 500).to_pylist():
                    found = cutter.chunks(t or "")
                    if found is None:
                        pieces.update(cutter.pieces(t or ""))
                    else:
                        chunks.update(found)
                if len(chunks) > MOST:
                    melt()
                if len(pieces) > 2 * MOST:
                    yield out()
        melt()
        yield out()

    return run


def sizer(path: str):
    """(piece, n) -> (piece, its tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(path)
        for b in batches:
            yield batch(PIECE, [b.column(0), cutter.sizes(b.column(0).to_pylist())])

    return run


USED = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("base", pa.int64()), ("first", pa.int32()), ("piece", pa.string()), ("n", pa.int64())])
USED_SQL = "id long, h long, n_bytes long, base long, first int, piece string, n long"


def adder(path: str, shared):
    """(id, text) -> the tokens of the text's frequent pieces, and a row for each of its other pieces with its frequency.

    A text without others has one row with a piece that no text has, so that every text has a first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, head = Cutter(path), shared.value
        known: dict[str, tuple[int, tuple]] = {}

        def learn(c: str) -> tuple[int, tuple]:
            ps = BYTE_PIECES.findall(c)
            found = known[c] = sum(head.get(p, 0) for p in ps), tuple(p for p in ps if p not in head)
            return found

        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                cols: list[list] = [[] for _ in USED]
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = t or ""
                    data, base, rare = t.encode(), 0, {}
                    chunks = cutter.chunks(t)
                    if chunks is None:
                        for p, n in Counter(cutter.pieces(t)).items():
                            if p in head:
                                base += n * head[p]
                            else:
                                rare[p] = n
                    else:
                        if len(known) > MOST:
                            known.clear()
                        for c, n in Counter(chunks).items():
                            size, others = known.get(c) or learn(c)
                            base += n * size
                            for p in others:
                                rare[p] = rare.get(p, 0) + n
                    h = xxhash.xxh3_64_intdigest(data)
                    if not rare:
                        rare[f"\0{h}"] = 0
                    m = len(rare)
                    for col, x in zip(cols, ([i] * m, [h - (1 << 64) * (h >> 63)] * m, [len(data)] * m, [base] * m, [1] + [0] * (m - 1), rare, rare.values()), strict=True):
                        col += x
                if cols[0]:
                    yield batch(USED, cols)

    return run


COUNTED = pa.schema([*list(USED)[:5], ("n", pa.int64())])
COUNTED_SQL = "id long, h long, n_bytes long, base long, first int, n long"


def rare_counter(path: str):
    """Rows sorted by piece -> frequency times tokens; each piece is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last = Cutter(path), (None, 0)
        for b in batches:
            piece, n = b.column(5), np.asarray(b.column(6))
            new = np.ones(len(piece), bool)
            new[1:] = np.asarray(pc.not_equal(piece.slice(1), piece.slice(0, len(piece) - 1)))
            names = piece.take(pa.array(np.flatnonzero(new))).to_pylist()
            known = names[:1] == [last[0]]
            sizes = [last[1]] * known + cutter.sizes(names[known:])
            if names:
                last = (names[-1], sizes[-1])
                yield batch(COUNTED, [*b.columns[:5], n * np.array(sizes, np.int64)[np.cumsum(new) - 1]])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, as the tokenizer file at path counts whole texts.

    Nulls count as empty; null ids stay null; repeated rows each give a row; very long texts are one row like others;
    other columns are ignored; empty tables give none.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    met = src.select("text").mapInArrow(tidy(piece_counter(path)), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # HEAD rows at most, whatever the corpus
    head = met.orderBy(F.desc("n"), "piece").limit(HEAD).repartition(parts).mapInArrow(tidy(sizer(path)), "piece string, n long")
    shared = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in head.collect()})
    used = src.mapInArrow(tidy(adder(path, shared)), USED_SQL)
    counted = used.repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(tidy(rare_counter(path)), COUNTED_SQL)
    by_row = counted.groupBy("id", "h", "n_bytes", "base").agg(F.sum("first").alias("copies"), F.sum("n").alias("n"))
    out = by_row.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("n_tokens", F.col("base") + (F.col("n") / F.col("copies")).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: The bytes of letters beyond ASCII, as the model names them: byte_level's characters for bytes that do not print.
_NAMES = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)], map(chr, range(256, 512))))
BYTE_NAMES = {c: "".join(_NAMES.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Ids:
    """Texts -> their ids as little-endian unsigned 32-bit numbers.

    The distinct words of some texts, lower-cased, are looked up once, cut into pieces together, and numpy lays their ids
    in the texts' order. Words and pieces that were met lately are remembered: each memory has a young and an old half.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.tok.get_vocab_size())]
        self.words, self.old_words, self.pieces, self.old_pieces = {}, {}, {}, {}

    def whole(self, text: str) -> bytes:
        return b"".join([self.bytes_of[i] for i in self.tok.encode(text, add_special_tokens=False).ids])

    def piece(self, p: str) -> bytes:
        out = self.old_pieces.get(p)
        if out is None:
            # the model names bytes by characters; those of ASCII are themselves
            out = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(p if p.isascii() else p.translate(BYTE_NAMES))])
        self.pieces[p] = out
        return out

    def learn(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words, none of which is in the young half."""
        if len(self.words) > WORDS // 2:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > WORDS // 2:
            self.pieces, self.old_pieces = {}, self.pieces
        new = [w for w in words if w not in self.old_words]
        known, made, own = self.pieces, [], []
        for p in LINES.findall("\n".join([*new, ""])):
            if p == "\n":
                made.append(own[0] if len(own) == 1 else b"".join(own))
                own = []
            else:
                found = known.get(p)
                own.append(self.piece(p) if found is None else found)
        self.words.update(zip(new, made, strict=True))
        if len(new) < len(words):
            self.words.update((w, self.old_words[w]) for w in words if w in self.old_words)
        return map(self.words.__getitem__, words)

    def encode_all(self, texts: pa.Array, most: int = 1 << 22) -> Iterator[bytes]:
        """The ids of each text, null as empty; about so many bytes of texts at a time."""
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
            yield from self.some(texts.slice(lo, hi - lo))
            lo = hi

    def some(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, UNSURE)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, pa.scalar("", pa.large_string()), texts)))
        coded = split.values.dictionary_encode()
        # no word holds a line's end; one join is faster than a value at a time
        lines = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        words = pc.binary_join(lines, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if len(coded.dictionary) else []
        ids = list(map(self.words.get, words))
        gaps = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(gaps, self.learn([words[k] for k in gaps]), strict=True):
            ids[k] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        code = np.asarray(coded.indices)
        n = size[code]
        upto = np.concatenate(([0], np.cumsum(n)))
        laid = flat[np.repeat(first[code] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        begin = (4 * upto[np.asarray(split.offsets)]).tolist()
        for k, whole in enumerate(np.asarray(odd)):
            yield self.whole(texts[k].as_py()) if whole else laid[begin[k] : begin[k + 1]]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's words of a file, at most WORDS of them."""
    return _ids.get(path) or _ids.setdefault(path, Ids(path))
