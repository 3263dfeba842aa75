"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are laid end to end, their suffixes sorted to the length of the longest piece, and every
piece of the vocabulary is binary-searched for the range of suffixes that begin with it. Each occurrence is an edge;
edges are sorted by position, and relaxed: for a unigram model by the best sum of scores to each position, for a
BPE model by the order of merges, a merge being an edge over two neighbouring tokens. Words recur, so a worker keeps
the tokens of those it has met, up to a bound. Texts are indexed in runs of bounded length, longer words in pieces that
overlap; their edges take a few bytes a character.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words that a worker remembers at most; others are encoded anew in each batch.
REMEMBERED = 300_000
BATCH_CHARS = 4 << 20
#: New words are indexed in runs of about this many characters.
INDEX_CHARS = 1 << 19
LONG_WORD = 256

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """Pieces of a model, with tables for encoding. Small (a few MB), so tasks get it with their code."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    dummy_prefix: bool = True
    tables: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"} | {"tables": {}}

    def prepare(self) -> dict:
        if self.tables:
            return self.tables
        t = self.tables
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        letters = sorted({c for i in usable for c in self.pieces[i]})
        t["letter"] = np.full(0x110000, 1, dtype=np.uint16)  # 0 pads, 1 is no piece's, 2 divides words
        t["letter"][[ord(c) for c in letters]] = np.arange(3, len(letters) + 3)
        t["depth"] = max((len(self.pieces[i]) for i in usable), default=1)
        t["unknown"] = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        t["bytes"] = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        t["id_of"] = {self.pieces[i]: i for i in usable}
        order = sorted(usable, key=lambda i: self.pieces[i])
        lengths = np.array([len(self.pieces[i]) for i in order], dtype=np.int64)
        low = np.zeros((len(order), t["depth"]), dtype=">u2")
        high = np.full((len(order), t["depth"]), 0xFFFF, dtype=">u2")
        for row, i in enumerate(order):
            codes = t["letter"][[ord(c) for c in self.pieces[i]]]
            low[row, : len(codes)] = codes
            high[row, : len(codes)] = codes
        t["low"], t["high"] = as_keys(low), as_keys(high)
        t["ids"], t["lengths"] = np.array(order, dtype=np.int32), lengths
        worth = np.array(self.scores)
        t["rank"] = np.append(-np.unique(-worth, return_inverse=True)[1].astype(np.int64), np.iinfo(np.int64).min)  # equal scores, equal ranks; the last is for no piece
        t["ints"] = list(range(len(self.pieces)))
        apart = "" if any("\n" in self.pieces[i] for i in usable) else "\n"
        crossing = any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        t["words"] = re.compile(r"(?s).+") if crossing else re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|{apart}" if apart else ""))
        t["text"] = [" " * len(p) if not p.strip(SPACE) else p.replace(SPACE, " ") for p in self.pieces]
        for value, i in t["bytes"].items():
            t["text"][i] = chr(value) if value < 128 else f"\udc00{value:02x}"
        for i, k in enumerate(self.kinds):
            if k == CONTROL:
                t["text"][i] = ""
            if k == UNKNOWN:
                t["text"][i] = " ⁇ "
        t["known"] = {}
        return t


def as_keys(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"S{2 * codes.shape[1]}").ravel()


def load(path: str = MODEL_PATH) -> Model:
    """A model file. Only models that leave texts as they are (identity normalisation, spaces kept) are taken."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as file:
        proto = pb.ModelProto.FromString(file.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation and prefix spaces can be used")
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be used")
    return Model([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], proto.trainer_spec.model_type, spec.add_dummy_prefix)


def edges_of(text: np.ndarray, t: dict) -> np.ndarray:
    """For each position and length the piece there, or -1: the edges by position."""
    depth = t["depth"]
    padded = np.zeros(len(text) + depth, dtype=">u2")
    padded[: len(text)] = text
    suffixes = as_keys(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(text)])
    wide = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(4, np.uint16)).astype(np.uint64), 4)[: len(text)]
    lead = (wide[:, 0] << np.uint64(48)) | (wide[:, 1] << np.uint64(32)) | (wide[:, 2] << np.uint64(16)) | wide[:, 3]
    array = np.argsort(lead, kind="stable")  # the first four letters settle most; what they leave is sorted in full
    ordered = lead[array]
    same = np.zeros(len(text), dtype=bool)
    same[1:] = ordered[1:] == ordered[:-1]
    tied = same.copy()
    tied[:-1] |= same[1:]
    places = np.flatnonzero(tied)
    members = array[places]
    array[places] = members[np.argsort(suffixes[members], kind="stable")]
    keys = suffixes[array]
    low, high = np.searchsorted(keys, t["low"]), np.searchsorted(keys, t["high"], side="right")
    met = np.flatnonzero(high > low)
    counts = high[met] - low[met]
    begin = np.repeat(low[met] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(met) else np.zeros(0, np.int64)
    table = np.full((len(text), depth + 1), -1, dtype=np.int32)
    table[array[begin], np.repeat(t["lengths"][met], counts)] = np.repeat(t["ids"][met], counts)
    return table


def merge_words(table: np.ndarray, start: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BPE of many words at once: word, start and end of each token. Each round makes the best merge of each word."""
    depth = table.shape[1] - 1
    word = np.repeat(np.arange(len(start)), size)
    left = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    right = left + 1
    done = []
    while len(left):
        length = np.append(right[1:] - left[:-1], depth + 1)
        pair = np.append(word[1:] == word[:-1], False) & (length <= depth)
        found = table[left, np.where(pair, length, 0)]
        worth = rank[np.where(pair, found, -1)]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.maximum.reduceat(worth, first), np.diff(np.append(first, len(word))))
        hit = np.flatnonzero((worth == best) & (best > rank[-1]))
        over = best == rank[-1]
        if over.any():
            done.append((word[over], left[over], right[over]))
        if not len(hit):
            break
        hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
        right[hit] = right[hit + 1]
        stay = ~over
        stay[hit + 1] = False
        word, left, right = word[stay], left[stay], right[stay]
    if not done:
        return word[:0], left[:0], right[:0]
    word, left, right = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(left, kind="stable")
    return word[order], left[order], right[order]


class Edges:
    """The edges of one long word, sorted by position and length: ids and lengths, and where each position's begin."""

    def __init__(self, text: np.ndarray, t: dict):
        depth, at, lengths, ids, counts = t["depth"], 0, [], [], []
        while at < len(text):  # in pieces; an edge may reach into the next one
            table = edges_of(text[at : at + INDEX_CHARS + depth], t)[: min(INDEX_CHARS, len(text) - at)]
            place, length = np.nonzero(table >= 0)
            lengths.append(length.astype(np.uint8))
            ids.append(table[place, length])
            counts.append(np.bincount(place, minlength=len(table)))
            at += INDEX_CHARS
        self.lengths, self.ids = np.concatenate(lengths), np.concatenate(ids)
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def piece(self, start: int, end: int) -> int:
        """The piece from start to end, or -1."""
        for i in range(self.begin[start], self.begin[start + 1]):
            if self.lengths[i] == end - start:
                return int(self.ids[i])
        return -1

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and ids of the edges over two characters."""
        two = np.flatnonzero(self.lengths == 2)
        return np.searchsorted(self.begin, two, side="right") - 1, self.ids[two]


def merge_long(edges: Edges, size: int, rank: np.ndarray) -> list[tuple[int, int]]:
    """BPE of one long word: the best merge first, of equal ones the first; those of two characters come in one sorted
    array, later ones by a heap. A merge is its rank and position in one number."""
    end, before = array("q", range(1, size + 1)), array("q", range(-1, size - 1))  # of tokens by their start; -1: gone
    place, ids = edges.pairs()
    first = np.sort((rank[ids].max(initial=0) - rank[ids] << 40) | place) if len(ids) else np.zeros(0, np.int64)
    top = int(rank[ids].max(initial=0)) if len(ids) else 0
    later: list[int] = []
    mask = (1 << 40) - 1

    def offer(a: int) -> None:
        b = end[a]
        if b < size and (i := edges.piece(a, end[b])) >= 0:
            heapq.heappush(later, (top - int(rank[i]) << 40) + a)

    at, chunk, taken = 0, [], 0
    while True:
        if at == len(chunk):
            chunk, at = first[taken : taken + 65536].tolist(), 0
            taken += len(chunk)
        if chunk and (not later or chunk[at] <= later[0]):
            key, at = chunk[at], at + 1
        elif later:
            key = heapq.heappop(later)
        else:
            break
        a, worth = key & mask, top - (key >> 40)
        b = end[a]
        if b < 0 or b >= size:
            continue
        c = end[b]
        i = edges.piece(a, c)
        if i < 0 or rank[i] != worth:  # one of the two has been merged since
            continue
        end[a], end[b] = c, -1
        if c < size:
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < size:
        out.append((a, end[a]))
        a = end[a]
    return out


def best_path(edges: Edges, size: int, scores: np.ndarray, unknown: float) -> list[tuple[int, int]]:
    """Unigram: relaxes the edges by position; an uncovered character costs as an unknown one."""
    best, back = array("d", [0.0]) + array("d", [-np.inf]) * size, array("q", [0]) * (size + 1)
    for i in range(size):
        covered = False
        for e in range(edges.begin[i], edges.begin[i + 1]):
            length, worth = int(edges.lengths[e]), best[i] + float(scores[edges.ids[e]])
            covered |= length == 1
            if worth > best[i + length]:
                best[i + length], back[i + length] = worth, i
        if not covered and best[i] + unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + unknown, i
    path, i = [], size
    while i:
        path.append((back[i], i))
        i = back[i]
    return path[::-1]


def spelled(ids: list[int], spans: list[tuple[int, int]], word: str, t: dict) -> tuple[int, ...]:
    """ids with -1 replaced by the bytes of what stands there, or one unknown piece for a run of such."""
    if -1 not in ids:
        return tuple(ids)
    out: list[int] = []
    for i, (a, b) in zip(ids, spans, strict=True):
        if i >= 0:
            out.append(i)
        elif t["bytes"]:
            out += [t["bytes"][x] for x in word[a:b].encode("utf-8", "surrogatepass")]
        elif not out or out[-1] != t["unknown"]:
            out.append(t["unknown"])
    return tuple(out)


def letters(text: str, t: dict) -> np.ndarray:
    return t["letter"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def encode_long(word: str, model: Model) -> tuple[int, ...]:
    """Token ids of one word on its own."""
    t = model.prepare()
    edges, size = Edges(letters(word, t), t), len(word)
    if model.kind == BPE:
        spans = merge_long(edges, size, t["rank"])
    else:
        lowest = min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0) - 10.0
        spans = best_path(edges, size, np.array(model.scores), lowest)
    return spelled([edges.piece(a, b) for a, b in spans], spans, word, t)


def encode_words(words: list[str], model: Model) -> list[tuple[int, ...]]:
    """Token ids of each word: short ones of a BPE model together, others one by one."""
    t = model.prepare()
    ints = t["ints"]
    out: list[tuple[int, ...] | None] = [None] * len(words)
    short = []
    for k, word in enumerate(words):
        if model.kind == BPE and len(word) <= LONG_WORD:
            short.append(k)
        else:
            out[k] = encode_long(word, model)
    at = 0
    while at < len(short):
        stop, chars = at, 0
        while stop < len(short) and (stop == at or chars + len(words[short[stop]]) < INDEX_CHARS):
            chars += len(words[short[stop]]) + 1
            stop += 1
        run = [words[k] for k in short[at:stop]]
        size = np.array([len(w) for w in run], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text = letters("\n".join(run) + "\n", t)
        text[start + size] = 2
        table = edges_of(text, t)
        word, left, right = merge_words(table, start, size, t["rank"])
        ids = table[left, np.minimum(right - left, t["depth"])].tolist()
        bounds = np.searchsorted(word, np.arange(len(run) + 1)).tolist()
        for j, k in enumerate(short[at:stop]):
            mine = ids[bounds[j] : bounds[j + 1]]
            if -1 in mine:
                own = slice(bounds[j], bounds[j + 1])
                mine = spelled(mine, list(zip((left[own] - start[j]).tolist(), (right[own] - start[j]).tolist(), strict=True)), words[k], t)
            out[k] = tuple([ints[i] for i in mine])
        at = stop
    return out


def encode(texts: list[str | None], model: Model) -> list[list[int]]:
    """Token ids of each text; a null or empty text has none."""
    t = model.prepare()
    known, find = t["known"], t["words"].findall
    prefix = SPACE if model.dummy_prefix else ""
    out: list[list[int]] = []
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars < BATCH_CHARS):
            chars += len(texts[stop] or "")
            stop += 1
        split = [find(prefix + x.replace(" ", SPACE)) if x else [] for x in texts[at:stop]]
        new = list(set(chain.from_iterable(split)).difference(known))
        of = dict(zip(new, encode_words(new, model), strict=True))
        if len(known) + len(new) <= REMEMBERED:
            known.update({w: i for w, i in of.items() if len(w) <= LONG_WORD})
        get = known.__getitem__ if known.keys() >= of.keys() else lambda w: of[w] if w in of else known[w]
        out += [list(chain.from_iterable(map(get, words))) for words in split]
        at = stop
    return out


WILD = re.compile("(?:\udc00[0-9a-f]{2})+")


def decode(ids: list[int] | None, model: Model) -> str | None:
    """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
    if ids is None:
        return None
    parts = model.prepare()["text"]
    text = "".join([parts[i] for i in ids])
    if "\udc00" in text:
        text = WILD.sub(lambda m: bytes.fromhex(m[0].replace("\udc00", "")).decode("utf-8", "replace"), text)
    return text[1:] if model.dummy_prefix and text[:1] == " " else text


def encoder(model: Model):
    def encode_batches(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 1000):
                part = texts[at : at + 1000]
                ids = encode(part, model)
                same = [x is None or decode(i, model) == x.replace(SPACE, " ") for i, x in zip(ids, part, strict=True)]
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return encode_batches


def encode_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip for each row of docs, over whole texts.

    round_trip tells that decoding gives the text back; U+2581 stands for a space in these models, so it is compared
    as one. A null or empty text has no tokens. Repeated rows are alike, null ids stay, further columns go. An empty
    table gives no rows. Each row is worked on alone; nothing is shuffled.
    """
    model = model or load()
    return docs.select("doc_id", "text").mapInArrow(encoder(model), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_documents(tokens: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text from doc_id, token_ids; null ids give a null text."""
    model = model or load()

    def decode_batches(batches):
        for batch in batches:
            texts = [decode(i, model) for i in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(decode_batches, "doc_id long, text string")
