"""Vector bin packing of tokenised documents into training sequences.

A document is cut into full sequences first; what is left of it, its tail, is an item with a demand in three
dimensions: tokens, segments and loss-bearing tokens. A sequence is filled by the dot-product heuristic: of the
items that fit all three limits, take the one whose demand, measured in shares of the limits, has the largest
inner product with what is still free. When nothing fits whole, the item with the largest product is cut to
what is free. A sequence that can't be filled (segment or loss limit, or no items left) is laid out anew as
sequences whose lengths are powers of two, which need no padding.

Documents are dealt to groups of bounded bytes and rows by a hash of doc_id and text, and a group is packed in
one task; the result depends on the table alone, not on its files. Only rows that repeat one another can crowd a
group; beyond MOST_BYTES of ids it is packed in parts. Words between ASCII white space are tokenised
independently of each other by the tokenizer used, so each distinct word of some documents is looked up once, and
a worker process keeps the ids of words that it has seen, up to CACHE_WORDS of at most CACHE_BYTES; beyond that it
starts anew and looks words up again.

Nulls: a null text is empty and gives its end id alone; rows with a null doc_id are packed like others, and
repeated rows stay separate. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_slices, give_back, ship, table

LIMIT_TOKENS, LIMIT_SEGMENTS = 4096, 64
GROUP_BYTES, GROUP_ROWS = 8 << 20, 10_000
MOST_BYTES, CHUNK_BYTES, GATHERED = 1 << 28, 12 << 20, 200_000
CACHE_WORDS, CACHE_BYTES = 500_000, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def dot_product_pack(demand: np.ndarray, limits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, length). demand: items x (tokens, segments, loss), tokens up to the limit and loss at most tokens, spread evenly when an item is cut."""
    max_tokens, max_segments, max_loss = map(float, limits)
    name = np.flatnonzero(demand[:, 0] > 0)
    tokens, loss = demand[name, 0].astype(float), demand[name, 2].astype(float)
    at = np.zeros(len(demand), np.int64)
    bins, alive = [], len(name)
    while alive:
        if alive < len(name) // 2:  # items that are placed have no tokens left
            kept = np.flatnonzero(tokens > 0)
            name, tokens, loss = name[kept], tokens[kept], loss[kept]
        free_tokens, free_loss, chosen = max_tokens, max_loss, []
        while alive and free_tokens > 0 and len(chosen) + 1 <= max_segments:
            # the segment's share is the same for all items that are left, so it doesn't change the order
            score = tokens * (free_tokens / max_tokens**2) + loss * (free_loss / max_loss**2)
            fit = (tokens <= free_tokens) & (loss <= free_loss)
            i = int((score * fit).argmax())
            if fit[i] and tokens[i] > 0:
                take = int(tokens[i])
            else:  # nothing fits whole: cut the best one
                i = int(score.argmax())
                per = loss[i] / tokens[i]
                take = int(min(tokens[i], free_tokens, free_loss // per if per > 0 else free_tokens))
                if take < 1:
                    break
            used = loss[i] * take / tokens[i]
            item = int(name[i])
            chosen.append((item, int(at[item]), take))
            at[item] += take
            free_tokens -= take
            free_loss -= used
            tokens[i] -= take
            loss[i] -= used
            if tokens[i] <= 0:
                tokens[i] = loss[i] = 0.0
                alive -= 1
        if not chosen:
            raise ValueError("a token exceeds the limits of an empty sequence")
        bins.append(chosen)
    return bins


def laid_out(chosen: list[tuple[int, int, int]], limit: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """(item, from, length, offset) of each sequence: one if it is full, else one for each binary digit of its length."""
    total = sum(x[2] for x in chosen)
    sizes = [limit] if total == limit else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    todo = list(reversed(chosen))
    for size in sizes:
        out, offset = [], 0
        while offset < size:
            i, start, length = todo.pop()
            take = min(length, size - offset)
            out.append((i, start, take, offset))
            offset += take
            if take < length:
                todo.append((i, start + take, length - take))
        yield out


def _strings(words: pa.Array) -> list[str]:
    """Words without white space as Python strings, by way of one long string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n") if len(words) else []


class WordTokenizer:
    """Token ids, as little-endian 32-bit bytes, of whole texts, by way of the ids of their words.

    For vocabularies of lower-cased words with word-end tokens, whose pattern keeps runs of letters together.
    """

    #: Latin letters, then other ASCII signs that can't begin a contraction or a special token; and those with one common sign.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{|}~]*)")
    PLAIN, SIGNS = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,|]?$", ".,|"

    def __init__(self, path: str, end: int, most: int | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tok = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.end = np.array([end], "<u4").tobytes()
        self.most = most or CACHE_WORDS
        self.seen: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, tok, text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_parts(self, parts: list[str]) -> None:
        """Runs of letters, in lower case: they need no normalising, and each ends in a token that ends a word."""
        for k in range(0, len(parts), 4096):
            part = parts[k : k + 4096]
            ids = self._ids(self.plain, " ".join(part))
            at = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            raw = ids.tobytes()
            for w, a, b in zip(part, at[:-1], at[1:], strict=True):
                self.parts[w] = raw[4 * a : 4 * b]

    def _tail(self, signs: str) -> bytes:
        tail = self.tails.get(signs)
        if tail is None:
            tail = self._ids(self.tok, signs).tobytes()
            if len(signs) < 4:
                self.tails[signs] = tail
        return tail

    def learn(self, words: list[str]) -> None:
        split = [self.SIMPLE.fullmatch(w) for w in words]
        halves = [(m[1].lower(), m[2]) if m else None for m in split]
        self._learn_parts(list({h[0] for h in halves if h}.difference(self.parts)))
        for w, h in zip(words, halves, strict=True):
            self.seen[w] = self.parts[h[0]] + self._tail(h[1]) if h else self._ids(self.tok, w).tobytes()

    def of_words(self, words: pa.Array) -> list[bytes]:
        """The ids of each of the distinct words."""
        for kept in (self.parts, self.seen):
            if len(kept) > self.most:
                kept.clear()
        self.seen[""] = b""
        low = pc.utf8_lower(words)
        body = pc.ascii_rtrim(low, characters=self.SIGNS)
        plain = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        signed = pc.not_equal(pc.binary_length(low), pc.binary_length(body))
        sign = pc.index_in(pc.if_else(signed, pc.utf8_slice_codeunits(low, -1), ""), pa.array(["", *self.SIGNS]))
        sign = sign.to_numpy(zero_copy_only=False)[plain].tolist()
        bodies = _strings(body.filter(pa.array(plain)))
        self._learn_parts(list(set(bodies).difference(self.parts)))
        parts, tail = self.parts, [self._tail(x) for x in ["", *self.SIGNS]]
        out = np.empty(len(words), object)
        out[plain] = [parts[b] + tail[x] if x else parts[b] for b, x in zip(bodies, sign, strict=True)]
        others = words.filter(pa.array(~plain)).to_pylist()
        self.learn(list(set(others).difference(self.seen)))
        out[~plain] = list(map(self.seen.get, others))
        for w in others:
            if len(w) > CACHE_BYTES:
                self.seen.pop(w, None)
        return out.tolist()

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id. Each distinct word is looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        ids = self.of_words(coded.dictionary)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(size)])[:-1]
        words, edge = coded.indices.to_numpy(), split.offsets.to_numpy()
        at = 0
        while at < len(texts):  # some texts' ids at a time
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + GATHERED, "right")) - 1)
            word = words[edge[at] : edge[to]]
            n = size[word]
            place = np.concatenate([[0], np.cumsum(n)])
            tokens = pool[np.repeat(first[word] - place[:-1], n) + np.arange(place[-1])]
            ends = place[edge[at : to + 1] - edge[at]].tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield tokens[a:b].tobytes() + self.end
            at = to

    #: One for each worker process, kept from task to task.
    made: dict[tuple, WordTokenizer] = {}

    @classmethod
    def of(cls, *args) -> WordTokenizer:
        if args not in cls.made:
            cls.made[args] = cls(*args)
        return cls.made[args]


def _pack_group(seq: int, docs: list[tuple], limits: tuple[int, int, int]) -> tuple[pa.RecordBatch, int]:
    """The pieces of docs (doc_id, ids, loss-bearing tokens), in sequences from seq on, and the next sequence's id."""
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    limit, rows = limits[0], []
    tails, where = [], []
    for k, (_, ids, loss) in enumerate(docs):
        n = len(ids) // 4
        full = n // limit if loss * limit <= limits[2] * n else 0
        for j in range(full):
            rows.append((k, j * limit, limit, seq, 0))
            seq += 1
        start = full * limit
        while start < n:  # where the loss limit forbids full sequences, an item is still below the limit
            length = min(n - start, limit if not full else n - start)
            tails.append((length, 1, loss * length / n))
            where.append((k, start))
            start += length
    if tails:
        for chosen in dot_product_pack(np.array(tails, float), np.array(limits, float)):
            for parts in laid_out(chosen, limit):
                for i, start, length, offset in parts:
                    k, base = where[i]
                    rows.append((k, base + start, length, seq, offset))
                seq += 1
    out = [[] for _ in range(8)]
    for k, start, length, s, offset in rows:
        doc_id, ids, loss = docs[k]
        n = len(ids) // 4
        for col, v in zip(out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, s, offset, loss * length // n), strict=True):
            col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [c.split()[0] for c in PIECES.split(", ")]), seq


def pack(docs: DataFrame, tokenizer: str, end: int, limits: tuple[int, int, int] = (LIMIT_TOKENS, LIMIT_SEGMENTS, LIMIT_TOKENS), loss_share: str | None = None, cache_words: int | None = None) -> DataFrame:
    """Pieces of `docs` (doc_id, text). limits: tokens, segments and loss-bearing tokens of a sequence.

    tokenizer: path of a tokenizers file, the same on each executor. loss_share: a column with the share of a
    document's tokens that bear loss (null: all), for instruction data; without it all tokens do. cache_words: words
    whose ids a worker keeps, about 300 bytes each; fewer cost time only.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.coalesce(F.col(loss_share).cast("double"), F.lit(1.0)) if loss_share else F.lit(1.0)).alias("share"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-size["bytes"] // GROUP_BYTES), -(-size["rows"] // GROUP_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.of(tokenizer, end, cache_words)
        by_group: dict[int, list[tuple]] = {}
        held: dict[int, int] = {}
        following: dict[int, int] = {}

        def packed(group: int) -> pa.RecordBatch:
            out, following[group] = _pack_group(following.get(group, group << 32), by_group.pop(group), limits)
            held[group] = 0
            return out

        for batch in byte_slices(batches, 1, CHUNK_BYTES):
            doc_ids, shares, of = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for doc_id, ids, share, group in zip(doc_ids, coder.encode(batch.column(1)), shares, of, strict=True):
                by_group.setdefault(group, []).append((doc_id, ids, int(len(ids) // 4 * min(1.0, max(0.0, share)))))
                held[group] = held.get(group, 0) + len(ids) + 100
                if held[group] > MOST_BYTES:  # rows that repeat one another
                    yield packed(group)
        for group in sorted(by_group):
            yield packed(group)
        give_back()

    dealt = docs.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    return dealt.repartition(groups, "group").mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the 49k word vocabulary, end id 2, sequences of 4096 tokens and at most 64 segments."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
