"""Personal data: base patterns, and a bidirectional LSTM with CRF transitions that finds other ways to write it."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, slices
from .sequence_tagger import Tagger, symbols, train

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Base patterns, fixed values. Runs of digits are taken whole, so that no text takes more than linear time.
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS = range(14, 20)
PHONE_DIGITS = range(10, 16)

#: Each character belongs to one window, which also shows so many on either side of its own.
OWN, MARGIN = 48, 24
WIDTH = OWN + 2 * MARGIN
#: Windows that the tagger is fitted on: of each kind, and without labels, at most.
FIT_WINDOWS = 120
#: How many other ways of writing a labelled window is learned in, with how many other values right beside its own, and
#: how many windows with harmless numbers are learned for each.
REWRITTEN, BESIDE, PLAIN = 3, 3, 1
#: What personal data can't do without: a digit, an at sign or a bracketed "at". Windows far from these have none.
ANCHOR = re.compile(r"[0-9@＠]|[\[({<] ?at ?[\])}>]", re.IGNORECASE)
ANCHOR_BYTES = np.zeros(256, dtype=bool)
ANCHOR_BYTES[list(b"0123456789@\xef[({<")] = True

TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
ALLOWED = np.array([[tag[0] != "I" or (before != "start" and before[2:] == tag[2:]) for tag in TAGS] for before in (*TAGS, "start")])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: bytes | str) -> str:
    return "".join(c for c in (text if isinstance(text, str) else text.decode("ascii")) if "0" <= c <= "9")


def base_spans(text: bytes) -> list[Span]:
    """The base patterns' matches, ends exclusive, in bytes: of each kind leftmost and without overlaps; a match that
    fails its further test is dropped and not tried again."""
    out, free, at = [], 0, text.find(b"@")
    while at >= 0:
        head = text[free:at]
        start = at - len(head) + len(head.rstrip(LOCAL))
        free = at + 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            out.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find(b"@", free)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m[0].split(b"."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if len(d := digits_of(m[0])) in CARD_DIGITS and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if len(digits_of(m[0])) in PHONE_DIGITS]
    return out


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def in_characters(text: bytes, spans: list[Span]) -> list[Span]:
    """Spans of bytes as spans of code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(before[a]), int(before[b])) for k, a, b in spans]


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def window_starts(text: str) -> np.ndarray:
    """Where the windows begin that own characters near an anchor; before the text is padding."""
    n = len(text)
    hit = np.unique(np.fromiter((m.start() for m in ANCHOR.finditer(text)), np.int64)) // OWN
    near = np.unique(np.concatenate([hit - 1, hit, hit + 1]))
    return near[(near >= 0) & (near * OWN < n)] * OWN - MARGIN


def window_text(text: str, start: int) -> str:
    return text[max(start, 0) : start + WIDTH].rjust(WIDTH - max(0, start + WIDTH - len(text)), "\0").ljust(WIDTH, "\0")


def tags_of(spans: Iterable[Span], width: int = WIDTH) -> np.ndarray:
    tags = np.zeros(width, dtype=np.int64)
    for kind, a, b in spans:
        a, b = max(a, 0), min(b, width)
        if a < b:
            tags[a:b] = TAGS.index(f"I-{kind}")
            tags[a] = TAGS.index(f"B-{kind}")
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    """The runs of tags of one kind, a new one at each B."""
    inside = np.flatnonzero(tags)
    out: list[list] = []
    for i in inside.tolist():
        kind, begins = KINDS[(tags[i] - 1) // 2], tags[i] % 2 == 1
        if out and out[-1][2] == i and out[-1][0] == kind and not begins:
            out[-1][2] = i + 1
        else:
            out.append([kind, i, i + 1])
    return [tuple(s) for s in out]


def rewritten(kind: str, value: str, rng: np.random.Generator) -> str:
    """Another way to write a value, with other digits: what labelled values are learned in besides their own form."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    value = re.sub("[0-9]", lambda _: str(rng.integers(10)), value)
    if kind == "email":
        at = pick("@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", "＠", " AT ".join("()"), "<at>")
        dot = pick(".", ".", "(dot)", " (dot) ", "[dot]", " [dot] ", "[.]", " . ") if at != "@" else pick("[.]", "(dot)", "[dot]", " [dot] ")
        local, host = value.split("@", 1)
        return local + at + host.replace(".", dot)
    if kind == "ip":
        parts = [str(rng.integers(1, 256)) for _ in range(4)]
        return pick("[.]", "(.)", "[dot]", " . ", "(dot)", "[.]").join(parts)
    if kind == "card":
        digits = str(rng.integers(3, 7)) + "".join(str(d) for d in rng.integers(0, 10, 15))
        return pick(".", "/", "_", "  ", "–", " - ", " ").join(digits[i : i + 4] for i in range(0, 16, 4))
    area, first, last = (str(rng.integers(10 ** (n - 1), 10**n)) for n in (3, 3, 4))
    lead = pick("", "", "1-", "1 ", "001-", "00 49 ", "0044 ", "tel:1-", "+1/")
    body = pick(f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"({area}){first}-{last}", f"{area}/{first}/{last}", f"{area} {first} {last}", f"({area}) {first} {last}")
    return lead.removeprefix("tel:") + body


def harmless(rng: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    forms = (
        lambda: f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2030)}", lambda: f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2030)}",
        lambda: f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", lambda: f"{n(1, 999)},{number(3)}.{number(2)}", lambda: f"{n(1, 100)}.{number(n(1, 8))}",
        lambda: f"{n(1900, 2020)}-{n(1950, 2030)}", lambda: number(n(1, 14)), lambda: f"978-{n(0, 10)}-{number(4)}-{number(4)}-{n(0, 10)}", lambda: f"@{'user' + number(2)}", lambda: f"{n(1, 30)} @ {n(1, 9)}.{number(2)}",
        lambda: "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, n(8, 40))), lambda: f"({n(1, 100)})", lambda: f"[{n(1, 100)}]", lambda: f"{n(1, 100)}%", lambda: " ".join(number(n(1, 5)) for _ in range(n(2, 7))),
        lambda: f"#{number(n(4, 9))}", lambda: f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.", lambda: "(at) the", lambda: f"{number(4)}-{number(2)}-{number(2)}T{n(10, 24)}:{n(10, 60)}", lambda: "[at] work",
    )
    return forms[int(rng.integers(len(forms)))]()


def replaced(text: str, span: Span, new: str) -> tuple[str, list[Span]]:
    """A window's text with something else in a span's place, cut to the width around it."""
    kind, a, b = span
    text = text[:a] + new + text[b:]
    return text[:WIDTH].ljust(WIDTH, "\0"), [(kind, a, min(a + len(new), WIDTH))]


def lessons(windows: list[tuple[str, list[Span]]], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """What the tagger learns from: labelled windows as they are, with their values in other ways to write them, with other
    values beside, and with harmless numbers in their place, or between the words of windows without labels."""
    rng, out = np.random.default_rng(seed), []
    values = [(k, text[a:b]) for text, spans in windows for k, a, b in spans if 0 < a and b < WIDTH]
    for text, spans in windows:
        out.append((text, spans))
        if not spans:
            words = [m.start() for m in re.finditer("(?<= )(?=[^ ])", text)]
            for _ in range(PLAIN if words else 0):
                at = words[int(rng.integers(len(words)))]
                out.append(((text[:at] + harmless(rng) + " " + text[at:])[:WIDTH], []))
        if len(spans) == 1 and 0 < spans[0][1] and spans[0][2] < WIDTH:
            kind, a, b = spans[0]
            for _ in range(REWRITTEN):
                out.append(replaced(text, spans[0], rewritten(kind, text[a:b], rng)))
            for _ in range(BESIDE):
                other, value = values[int(rng.integers(len(values)))]
                own, sign = re.sub("[0-9]", lambda _: str(rng.integers(10)), text[a:b]), (" ", " ", ", ", "; ")[int(rng.integers(4))]
                way = int(rng.integers(5))
                value = rewritten(other, value, rng) if way == 0 else harmless(rng) if way == 1 else re.sub("[0-9]", lambda _: str(rng.integers(10)), value)
                at = a + len(own) + len(sign)
                longer, (first,) = replaced(text, spans[0], own + sign + value)
                out.append((longer, [(kind, a, a + len(own)), *([(other, at, min(first[2], WIDTH))] if way != 1 and at < WIDTH else [])]))
            for _ in range(PLAIN):
                out.append((replaced(text, spans[0], harmless(rng))[0], []))
    return np.stack([symbols(t) for t, _ in out]), np.stack([tags_of(s) for _, s in out])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[Span]]]:
    """Row number, text and base spans of the rows that have anything like an anchor."""
    for first, data, at in slices(batch.column("text")):
        hits = np.flatnonzero(ANCHOR_BYTES[data])
        for i in np.unique(np.searchsorted(at, hits, side="right") - 1).tolist():
            text = data[at[i] : at[i + 1]].tobytes()
            yield first + i, text, base_spans(text)


def labelled_windows(docs: DataFrame) -> DataFrame:
    """stratum, text, spans: the windows of all texts, labelled by the base patterns; stratum is a kind or empty."""

    def cut(batches):
        for batch in batches:
            out = []
            for _, raw, spans in rows_of(batch):
                text = raw.decode("utf-8", "replace")
                spans = in_characters(raw, spans)
                for s in window_starts(text).tolist():
                    inner = [(k, max(a - s, 0), min(b - s, WIDTH)) for k, a, b in spans if a < s + WIDTH and b > s]
                    out.append((inner[0][0] if inner else "", window_text(text, s), [f"{k}:{a}:{b}" for k, a, b in inner]))
            stratum, text, spans = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(stratum, pa.string()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.string()))], ["stratum", "text", "spans"])

    return docs.select("text").mapInArrow(cut, "stratum string, text string, spans array<string>")


def fit(docs: DataFrame, fit_windows: int = FIT_WINDOWS, **parameters) -> Tagger | None:
    """A tagger learned from windows that the base patterns label: fit_windows for each kind at most, and as many without.

    Windows go by a hash of their text to so many classes, and the one of least hash stands for its class; only these
    come to the driver. Without any labelled window there is no tagger.
    """
    of = F.xxhash64("text", F.lit(3))
    windows = labelled_windows(docs).withColumns({"bin": F.pmod(F.xxhash64("text"), F.lit(fit_windows)), "hash": of})
    chosen = windows.groupBy("stratum", "bin").agg(F.min_by(F.struct("text", "spans"), F.struct("hash", "text")).alias("w")).select("stratum", "w.*").toPandas()
    chosen = chosen.sort_values(["stratum", "text"])
    if not (chosen["stratum"] != "").any():
        return None
    parse = lambda s: (s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2]))
    return train(*lessons([(t, [parse(s) for s in spans]) for t, spans in zip(chosen["text"], chosen["spans"], strict=True)]), ALLOWED, **parameters)


AT = re.compile(r" ?(?:@|＠|[\[({<] ?at ?[\])}>]) ?", re.IGNORECASE)
DOT = re.compile(r" ?(?:\.|[\[({<] ?(?:\.|dot) ?[\])}>]) ?", re.IGNORECASE)
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,4}[ ./-])?(?:[0-9]{2} )?\(?[0-9]{2,4}\)?[ ./-]?[0-9]{2,4}[ ./-][0-9]{3,4}")


def holds(kind: str, value: str) -> bool:
    """Whether a decoded value can be what its tag says, whatever signs stand between its parts."""
    if kind == "email":
        return bool(PLAIN_EMAIL.fullmatch(DOT.sub(".", AT.sub("@", value, count=1))))
    digits = digits_of(value)
    if kind == "card":
        return len(digits) in CARD_DIGITS and luhn(digits) and not any(c.isalpha() for c in value)
    if kind == "ip":
        parts = DOT.split(value)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    return len(digits) in PHONE_DIGITS and bool(PHONE_SHAPE.fullmatch(value))


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without signs and spaces at its ends, but with a bracket or plus before a number."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def stands_alone(kind: str, text: str, a: int, b: int) -> bool:
    """Whether no letter or digit touches the span, and no more of a number goes on beyond one sign."""
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    if before and unicodedata.category(before[-1])[0] in "LN" or after and unicodedata.category(after[0])[0] in "LN":
        return False
    return kind == "email" or not (len(before) == 2 and before[0].isdigit() and before[1] in "-./_,:" or len(after) == 2 and after[1].isdigit() and after[0] in "-./_,:")


def added_spans(tagger: Tagger, rows: list[tuple[int, bytes, list[Span]]]) -> dict[int, list[Span]]:
    """What the tagger finds beside the base spans (in code points), by row number.

    All windows of all rows are decoded; each character takes its tag from the window that owns it, and the spans are
    read from the joined tags of the whole text. A span is kept if it can be what its tag says, stands alone and
    touches no base span.
    """
    texts = {i: raw.decode("utf-8", "replace") for i, raw, _ in rows}
    places = [(i, s) for i, text in texts.items() for s in window_starts(text).tolist()]
    tags = {i: np.zeros(len(t), dtype=np.int64) for i, t in texts.items()}
    for low in range(0, len(places), 1024):
        some = places[low : low + 1024]
        decoded = tagger.decode(np.stack([symbols(window_text(texts[i], s)) for i, s in some]))
        for (i, s), row in zip(some, decoded, strict=True):
            own = s + MARGIN
            end = min(own + OWN, len(tags[i]))
            tags[i][own:end] = row[MARGIN : MARGIN + end - own]
    out = {}
    for i, raw, base in rows:
        text, taken, found = texts[i], in_characters(raw, base), []
        for kind, a, b in spans_of(tags[i]):
            a, b = trimmed(text, a, b)
            if a < b and not any(x < b and a < y for _, x, y in taken) and holds(kind, text[a:b]) and stands_alone(kind, text, a, b):
                found.append((kind, a, b))
        out[i] = found
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """One row per row of docs: RESULT with the base spans' counts and digest, and all spans, those of the tagger included.

    A null or empty text has no spans. Repeated rows are alike, a null doc_id stays null, and extra columns don't
    matter. An empty table gives no rows. Nothing is shuffled; windows with none of the characters that personal data
    needs aren't decoded. Base spans of different kinds may overlap, and all of them stay.
    """
    none = hashlib.sha256().hexdigest()

    def found(batches):
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n
            rows, held = [], 0
            for row in rows_of(batch):
                rows.append(row)
                held += len(row[1])
                if held > 8 << 20:
                    fill(rows, counts, digests, spans)
                    rows, held = [], 0
            fill(rows, counts, digests, spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], [f.split()[0] for f in RESULT.split(", ")])

    def fill(rows, counts, digests, spans):
        more = added_spans(tagger, rows) if tagger else {}
        for i, raw, base in rows:
            own = in_characters(raw, base)
            for k, kind in enumerate(KINDS):
                counts[k, i] = sum(s[0] == kind for s in own)
            digests[i] = hashlib.sha256(listed(own).encode()).hexdigest()
            spans[i] = listed([*own, *more.get(i, [])])

    return docs.select("doc_id", "text").mapInArrow(found, RESULT)


def personal_data(docs: DataFrame, **parameters) -> DataFrame:
    """find() with a tagger fitted to docs."""
    return find(docs, fit(docs, **parameters))
