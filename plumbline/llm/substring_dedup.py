"""Suffix-array dedup: bytes of strings of fixed length that occur before in the corpus go, by prefix-free parsing.

A rolling hash of GRAM bytes marks triggers: of the grams in a string of LENGTH bytes the one with the least hash, so
that every string has one and equal strings have it at the same place. Consecutive strings with one trigger make a
phrase, the text from the first one's start to the last one's end: phrases begin and end by content, overlap, and hold
every string exactly once. The sequence of phrases in corpus order is the parse, the distinct phrases are the dictionary.

A phrase that the parse has before is a repeat as a whole. Strings of different phrases can only be equal where these
share a trigger; such phrases of the dictionary meet, with their bytes, in the bucket of their trigger. There the suffixes
of the dictionary (one for each string) are sorted lexicographically to LENGTH bytes, byte by byte, and those that agree
in all of them, an interval of the suffix array, are put in the order of the parse: all but the first are repeats.
No suffix need be compared beyond its phrase, so the order of the parse at equal suffixes is that of its phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import buffers, id_blocks, lanes, mix, span_hashes

LENGTH = 100
GRAM = 40
#: Texts are parsed in pieces of about so many bytes, whose hashes stay in a processor's cache.
CHUNK = 1 << 16
POSITION = np.uint64((1 << 24) - 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Strings of triggers with more different phrases than this are dealt out one by one, by their own bytes.
HOT = 4096

PHRASES, STRINGS = 0, 1
SEEN, SHARED, MANY = 1, 2, 4
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Text bytes for each byte of a question, about: a phrase of 20 bytes begins with every 30 bytes.
TEXT_PER_ASKED = 1.5


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of width bytes, from those of 8, 16, 32, ... bytes."""
    n, eight = len(data) - width + 1, lanes(data)
    tail = (np.uint64(1) << np.uint64(8 * (width & 7))) - np.uint64(1)
    if width < 8:
        return mix((eight[:n] & tail) + STEP)
    level, size, out, done = mix(eight[: len(data) - 7] + STEP), 8, None, 0
    while size <= width:
        if width & size:
            part = level[done : done + n]
            out, done = part if out is None else mix(out * STEP + part), done + size
        if 2 * size <= width:
            level = level[:-size] * STEP + level[size:]
            level ^= level >> np.uint64(29)
        size *= 2
    return mix(out * STEP + (eight[done : done + n] & tail)) if width & 7 else out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, from those of 2, 4, 8, ... values."""
    n, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


class Parse:
    """Phrases of a block in corpus order: hashes of the trigger and (96 bits) of the phrase, first and last string."""

    KINDS = (("trigger", np.uint64), ("phrase", np.uint64), ("check", np.uint32), ("low", np.int64), ("high", np.int64))

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, gram: int):
        self.data, self.length, self.gram = data, length, gram
        parts = []
        row = 0
        while row < len(at) - 1:
            if at[row + 1] - at[row] > CHUNK:  # a long text goes in pieces that overlap
                for begin in range(at[row], max(at[row] + 1, at[row + 1] - length + 1), CHUNK):
                    end = min(begin + CHUNK + length - 1, at[row + 1])
                    parts.append(self.phrases(begin, end, np.array([0, end - begin])))
                row += 1
                continue
            last = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
            parts.append(self.phrases(at[row], at[last], at[row : last + 1] - at[row]))
            row = last
        for k, (name, kind) in enumerate(self.KINDS):
            setattr(self, name, np.concatenate([p[k] for p in parts if p]) if any(parts) else np.zeros(0, kind))

    def phrases(self, begin: int, end: int, at: np.ndarray):
        piece = self.data[begin:end]
        if len(piece) < self.length:
            return ()
        grams = window_hashes(piece, self.gram)
        least = sliding_min((grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), self.length - self.gram + 1)
        owner = (least & POSITION).astype(np.int64)
        inside = np.zeros(len(piece) + 1, dtype=np.int8)
        long = np.diff(at) >= self.length
        inside[at[:-1][long]] += 1
        inside[at[1:][long] - self.length + 1] -= 1
        start = np.flatnonzero(np.cumsum(inside[: len(owner)], dtype=np.int8) > 0)
        if not len(start):
            return ()
        owner = owner[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        low, high = start[first], start[np.append(first[1:], len(start)) - 1]
        size = high - low + self.length
        # two hashes of the phrase's bytes, in which those of the grams have no part, so that a phrase whose trigger meets
        # another by chance is still told apart by 96 bits
        phrase, check = (span_hashes(piece, low, low + size, seed) for seed in (2, 3))
        # least hashes are small ones; mixed again they spread over the buckets
        return mix(grams[owner[first]]), phrase, (check >> np.uint64(32)).astype(np.uint32), low + begin, high + begin

    def places(self, which: np.ndarray) -> np.ndarray:
        """Starts of the strings in the phrases given, one phrase after the other."""
        return runs(self.low[which], self.high[which] - self.low[which] + 1)


def runs(low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for each, so many as counts says."""
    return np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(low) else np.zeros(0, np.int64)


def suffix_array(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts' indexes in lexicographic order of the length bytes there, equal ones in their given order; and
    whether each, in that order, begins a new string. Eight bytes settle most; ties are sorted by the next eight."""
    order = np.arange(len(start))
    new = np.zeros(len(start), dtype=bool)
    new[:1] = True
    eight = lanes(data)
    tied = order.copy()
    for depth in range(0, length, 8):
        value = eight[start[order[tied]] + depth].byteswap()
        if length - depth < 8:
            value >>= np.uint64(8 * (8 - length + depth))
        group = np.cumsum(new)[tied]
        by = np.lexsort((value, group)) if depth else np.argsort(value, kind="stable")
        order[tied] = order[tied][by]
        value, group = value[by], group[by]
        differs = (value[1:] != value[:-1]) & (group[1:] == group[:-1])
        new[tied[1:][differs]] = True
        same = ~new
        same[:-1] |= ~new[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
    return order, new


def repeated(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each start whether a start given before has the same string."""
    order, new = suffix_array(data, start, length)
    out = np.zeros(len(start), dtype=bool)
    out[order[~new]] = True
    return out


def parsed(docs: pa.Table, length: int, gram: int) -> tuple[pa.Table, np.ndarray, np.ndarray, Parse]:
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("hash", "ascending")], null_placement="at_start"))
    data, at = buffers(docs.column("text"))
    return docs, data, at, Parse(data, at, length, gram)


def distinct(parse: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases of a block: the first of each kind, sorted by hashes; the number of each one's kind; whether it
    is the first."""
    order = np.lexsort((parse.check, parse.phrase, parse.trigger))
    new = np.ones(len(order), dtype=bool)
    for name in ("trigger", "phrase", "check"):
        value = getattr(parse, name)[order]
        new[1:] = (value[1:] != value[:-1]) | (new[1:] if name != "trigger" else False)
    kind = np.zeros(len(order), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = np.zeros(len(order), dtype=bool)
    lead[order[new]] = True  # lexsort is stable
    return order[new], kind, lead


IDENTITY = np.dtype([("phrase", "<u8"), ("check", "<u4")])


def asker(length: int, gram: int, buckets: int):
    def questions(key, docs):
        parse = parsed(docs, length, gram)[3]
        first, _, _ = distinct(parse)
        identity = np.zeros(len(first), dtype=IDENTITY)
        identity["phrase"], identity["check"] = parse.phrase[first], parse.check[first]
        return blobs.ask(key[0].as_py(), PHRASES, parse.trigger[first], buckets, identity)

    return questions


def judged(asked: pa.Table, hot: int = HOT) -> pa.Table:
    """For each phrase: SEEN in a block before, SHARED trigger with another phrase, MANY other phrases."""
    blocks, starts, triggers, question = blobs.gathered(asked)
    identity = np.concatenate([np.frombuffer(x, IDENTITY) for x in asked.column("extra").to_pylist()]) if len(asked) else np.zeros(0, IDENTITY)
    phrase, check = identity["phrase"], identity["check"]
    order = np.lexsort((blocks[question], check, phrase, triggers))
    t, p, c = triggers[order], phrase[order], check[order]
    same = t[1:] == t[:-1]
    equal = same & (p[1:] == p[:-1]) & (c[1:] == c[:-1])
    group = np.cumsum(np.append(True, ~same)) - 1
    kinds = np.bincount(group, weights=np.append(True, ~equal)).astype(np.int64)[group]
    out = np.zeros(len(order), dtype=np.uint8)
    out[order] = np.where(np.append(False, equal), SEEN, 0) | np.where(kinds > 1, SHARED, 0) | np.where(kinds > hot, MANY, 0)
    return blobs.answers(asked, out, starts)


class Open:
    """What of a block's parse must be looked at string by string: places, in messages to the buckets of STRINGS."""

    def __init__(self, parse: Parse, replies: pa.Table, buckets: int):
        first, kind, lead = distinct(parse)
        told = blobs.read_values(replies, PHRASES, parse.trigger[first], buckets, np.uint8)[kind]
        self.repeat = ((told & SEEN) > 0) | ~lead
        look = ~self.repeat & ((told & SHARED) > 0)
        some = np.flatnonzero(look & ((told & MANY) == 0))
        hot = parse.places(np.flatnonzero(look & ((told & MANY) > 0)))
        again = repeated(parse.data, hot, parse.length)  # here, so that a common string is sent once a block
        self.known, hot = hot[again], hot[~again]
        low, counts = np.concatenate([parse.low[some], hot]), np.concatenate([parse.high[some] - parse.low[some] + 1, np.ones(len(hot), np.int64)])
        where = np.concatenate([blobs.bucket_of(parse.trigger[some], buckets), blobs.bucket_of(string_hashes(parse.data, hot, parse.length), buckets)])
        order = np.lexsort((low, where))
        self.low, self.counts = low[order], counts[order]
        self.met, self.cuts = blobs.cuts(where[order])  # buckets, and where the places for each begin

    def ask(self, parse: Parse, block: int) -> pa.Table:
        counts, texts = [], []
        for a, z in zip(self.cuts, self.cuts[1:], strict=False):
            low, n = self.low[a:z], self.counts[a:z]
            counts.append(n.astype(np.int32).tobytes())
            texts.append(parse.data[runs(low, n + parse.length - 1)].tobytes())
        n = len(self.met)
        return pa.table({"bucket": pa.array(self.met, pa.int32()), "block": pa.array(np.full(n, block), pa.int64()), "flow": pa.array(np.full(n, STRINGS), pa.int32()), "hashes": pa.array(counts, pa.binary()), "extra": pa.array(texts, pa.binary())})

    def repeats(self, replies: pa.Table) -> np.ndarray:
        """Starts of the strings that occur before."""
        found = [self.known]
        at = np.searchsorted(self.met, replies.column("bucket").to_numpy()).tolist()
        for b, flow, bits in zip(at, replies.column("flow").to_pylist(), replies.column("bits").to_pylist(), strict=True):
            if flow == STRINGS:
                own = slice(self.cuts[b], self.cuts[b + 1])
                place = runs(self.low[own], self.counts[own])
                found.append(place[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(place)).astype(bool)])
        return np.concatenate(found)


def string_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """To deal strings out, no more: a mix of their eight-byte parts."""
    eight, out = lanes(data), np.zeros(len(start), dtype=np.uint64)
    for k in [*range(0, length - 7, 8), max(0, length - 8)]:
        out = mix(out * STEP + eight[start + k]) if length >= 8 else out + data[start]
    return mix(out)


def string_asker(length: int, gram: int, buckets: int):
    def questions(key, docs, replies):
        parse = parsed(docs, length, gram)[3]
        return Open(parse, replies, buckets).ask(parse, key[0].as_py())

    return questions


def sorter(length: int):
    """Of a bucket: the suffix array of its part of the dictionary, and for each string whether it occurs before."""

    def sort(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("block")
        counts = [np.frombuffer(x, np.int32).astype(np.int64) for x in asked.column("hashes").to_pylist()]
        data = np.frombuffer(b"".join(asked.column("extra").to_pylist()), np.uint8)
        each = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        sizes = each + length - 1
        start = runs(np.cumsum(sizes) - sizes, each)
        ends = np.concatenate([[0], np.cumsum([int(c.sum()) for c in counts])]).astype(np.int64)
        return blobs.answers(asked, repeated(data, start, length), ends)

    return sort


def remover(length: int, gram: int, buckets: int, with_text: bool):
    def remove(key, docs, replies):
        docs, data, at, parse = parsed(docs, length, gram)
        found = Open(parse, replies, buckets)
        single = found.repeats(replies)
        begin = np.concatenate([parse.low[found.repeat], single])
        end = np.concatenate([parse.high[found.repeat], single]) + length
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        new = np.ones(len(begin), dtype=bool)  # a run of removed bytes ends with its document
        new[1:] = (begin[1:] > end[:-1]) | ((begin[1:] == end[:-1]) & np.isin(begin[1:], at))
        begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1] if len(end) else end
        of = np.searchsorted(begin, at)
        removed, spans, digests, texts = [], [], [], []
        for i in range(len(docs)):
            a, z = begin[of[i] : of[i + 1]], end[of[i] : of[i + 1]]
            kept = b"".join(data[x:y].tobytes() for x, y in zip(np.append(at[i], z), np.append(a, at[i + 1]), strict=True))
            removed.append(int((z - a).sum()))
            spans.append(len(a))
            texts.append(kept if with_text else None)
            digests.append(hashlib.sha256(kept).hexdigest())
        out = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(texts, pa.binary())} if with_text else {}))

    return remove


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs; with_text adds kept, the bytes that stay.

    A byte goes if a string of length bytes that covers it starts earlier too: in a row before in the order of doc_id
    (null ids first; of equal ids, by a hash of the text), or earlier in the row. Strings are judged on the texts as given and never cross
    rows. Null text: as empty, 0 bytes. Texts under length bytes lose nothing. Repeated rows: the later ones are
    copies. An empty table gives no rows; further columns go.

    Blocks of documents and buckets of triggers have bounded sizes (see blobs), so their numbers grow with the corpus.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes, buckets = blobs.sizes(total, TEXT_PER_ASKED)
    blocks = id_blocks(given, block_bytes).select("block", "doc_id", "text", F.xxhash64("text").alias("hash")).repartition("block")
    asked = blocks.groupBy("block").applyInArrow(asker(length, gram, buckets), blobs.ASKED)
    replies = asked.groupBy("bucket").applyInArrow(lambda t: judged(t, hot), blobs.ANSWER)
    strings = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(string_asker(length, gram, buckets), blobs.ASKED)
    more = strings.groupBy("bucket").applyInArrow(sorter(length), blobs.ANSWER)
    schema = RESULT + (", kept binary" if with_text else "")
    return blocks.groupBy("block").cogroup(replies.unionByName(more).groupBy("block")).applyInArrow(remover(length, gram, buckets, with_text), schema)
