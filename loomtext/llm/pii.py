"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans the patterns miss."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Those of ip and email are entered only where a match can begin, which keeps them linear.
EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [(2 * int(d) - 9 if d > "4" else 2 * int(d)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(parts: list[str]) -> bool:
    return all((p.lstrip("0") or "0").isdecimal() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start; per kind leftmost and without overlap, failing matches dropped."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in EMAIL_RIGHT.finditer(text):
            start = m.start()
            while start > done and EMAIL_LEFT.match(text, start - 1):
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if octets(m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\n|[^\S\n]+|(?s:.)")
#: Where training looks: a run with several digits, an at sign, or words around "at" and "dot".
TRIGGER = re.compile(r"[0-9][0-9().\x20/_-]{5,}[0-9]|@|\b(?:at|dot)\b\W{1,3}\w{1,40}\W{1,3}(?:dot|at)\b", re.IGNORECASE)
#: Characters around a trigger that are looked at, and the most tokens of an entity.
AROUND, LONGEST = 64, 24


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text that hold triggers with what is around them, for training."""
    return joined((max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)) for m in TRIGGER.finditer(text))


def joined(parts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts by start, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: How an address may be written at all, with marks or words for the at sign and the dots. A word is taken whole or not at all, and
#: white space at once: a match never ends inside either, and without that a long word would be tried from each of its letters.
NAME, HOST = r"(?:\w++|[+%-])+", r"(?:\w++|-)+"
OPEN, CLOSE = r"\s*+(?:[(\[<]\s*+)?", r"\s*+(?:[)\]>]\s*+)?"
LEFT = rf"{NAME}(?:\W{{0,3}}(?:\.|\bdot\b)\W{{0,3}}{NAME})*{OPEN}"
ADDRESS = re.compile(rf"{LEFT}(?:@|\bat\b){CLOSE}{HOST}(?:{OPEN}(?:\.|\bdot\b){CLOSE}{HOST})+", re.IGNORECASE)
JOINTS = frozenset(("@", "at", ".", "dot"))
#: Characters of tokens of letters that aren't letters, as fractions: kinds_of takes such tokens for marks.
ODD = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: All that kinds_of can take for numbers lies in such a run without letters; for addresses, around such a start and end.
NUMBERS = re.compile(rf"[0-9](?:[^\n\w]|[\d_]|[{ODD}][^\W\d_]*+)*[0-9]")
DIGITS = re.compile("[0-9]+")
AT = re.compile(r"(?:@|\bat\b)\s*+(?:[)\]>]\s*+)?(?=[\w-])\w*(?:-\w*){0,24}\s*+(?:[(\[<]\s*+)?(?:\.|\bdot\b)\s*+(?:[)\]>]\s*+)?[\w-]", re.IGNORECASE)
ADDRESS_LEFT = re.compile(rf"(?<![\w+%-]){LEFT}\Z", re.IGNORECASE)
#: Common last labels of host names.
LAST_LABELS = frozenset("com org net edu gov info biz io eu us uk de fr es it nl ch at be pl se no dk fi pt ie ca au nz jp cn in br mx".split())


def shape(text: str) -> str:
    """A span with runs of digits as their length, letters as a, spaces as _."""
    return re.sub(r"[0-9]+|[^\W\d_]+|\s+", lambda m: str(len(m[0])) if m[0][0] in "0123456789" else "_" if m[0].isspace() else "a", text)


def kinds_of(tokens: list[str]) -> list[str]:
    """Kinds that a segment can have at all."""
    first, last = tokens[0], tokens[-1]
    if first.isspace() or last.isspace() or "\n" in tokens:
        return []
    out = []
    n = sum(len(t) for t in tokens if t[0] in "0123456789")
    words = {t.lower() for t in tokens}
    if ("@" in words or "at" in words) and ("." in words or "dot" in words) and len(tokens) >= 5 and first.lower() not in JOINTS and last.lower() not in JOINTS:
        if ADDRESS.fullmatch("".join(tokens)):
            out.append("email")
    if n >= 4 and first[0] in "0123456789+(" and last[0] in "0123456789" and not any(t[0].isalpha() for t in tokens):
        groups = [t for t in tokens if t[0] in "0123456789"]
        if len(groups) == 4 and len(tokens) >= 7 and first[0] not in "+(":
            out.append("ip")
        if 13 <= n <= 19 and first[0] not in "+(":
            out.append("card")
        if 9 <= n <= 15:
            out.append("phone")
    return out


def kind_of(c: str) -> str:
    """Neighbours of the same kind, if it has a name, are in one token."""
    return "9" if "0" <= c <= "9" else "a" if c.isalnum() and not c.isdecimal() else "_" if c.isspace() and c != "\n" else ""


def back(text: str, at: int, tokens: int) -> int:
    """The place so many tokens before a place where a token starts, or that of the line's start."""
    while at and tokens and text[at - 1] != "\n":
        kind = kind_of(text[at - 1])
        at, tokens = at - 1, tokens - 1
        while kind and at and kind_of(text[at - 1]) == kind:
            at -= 1
    return at


def on(text: str, at: int, tokens: int) -> int:
    """The place so many tokens behind a place where a token starts, or that of the line's end."""
    while tokens and (m := TOKEN.match(text, at)) and m[0] != "\n":
        at, tokens = m.end(), tokens - 1
    return at


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of a text, at bounds of tokens, that hold every segment for which kinds_of has a kind, and what its features look at."""
    found = []
    for m in NUMBERS.finditer(text):
        groups = DIGITS.findall(m[0])
        if len(groups) >= 4 or sum(map(len, groups)) >= 9:
            a = m.start()
            for _ in range(LONGEST):
                before = back(text, a, 1)
                if before == a or text[before].isalpha():
                    break
                a = before
            found.append((a, m.end()))
    for m in AT.finditer(text):
        a = back(text, m.start(), LONGEST)
        if left := ADDRESS_LEFT.search(text[a : m.start()]):
            found.append((a + left.start(), on(text, m.start(), LONGEST)))
    out = []
    for a, b in found:
        while a and (text[a - 1].isspace() or text[a - 1] in "()[]<>"):
            a -= 1
        while b < len(text) and (text[b].isspace() or text[b] in "()[]<>"):
            b += 1
        if a:
            kind, a = kind_of(text[a - 1]), a - 1
            while kind and a and kind_of(text[a - 1]) == kind:
                a -= 1
        out.append((a, m.end() if (m := TOKEN.match(text, b)) else b))
    return joined(out)


def beside(tokens: list[str], at: int, step: int) -> str:
    """The next token from `at` on that isn't a space or bracket, in lower case."""
    while 0 <= at < len(tokens) and (tokens[at].isspace() or tokens[at] in "()[]<>"):
        at += step
    return tokens[at].lower() if 0 <= at < len(tokens) else ""


def features(kind: str, all_tokens: list[str], i: int, j: int) -> list[str]:
    """Names of a segment's features: each is about the whole span, or about its neighbours."""
    tokens = all_tokens[i:j]
    before = all_tokens[i - 1][-1] if i else " "
    after = all_tokens[j][0] if j < len(all_tokens) else " "
    text = "".join(tokens)
    digits = digits_of(text)
    groups = [t for t in tokens if t[0] in "0123456789"]
    marks = "".join(sorted({t if not t.isspace() else "_" for t in tokens if not t[0].isalnum()}))
    names = [
        "bias",
        f"shape={shape(text)}",
        f"marks={marks}",
        f"digits={len(digits)}",
        f"groups={min(9, len(groups))}",
        f"first={tokens[0] if not tokens[0][0].isalnum() else 'a' if tokens[0][0].isalpha() else '9'}",
        f"before={before if before in '@.-_/=+#(' else '_' if before.isspace() else 'a'}",
        f"after={after if after in '@.-_/=+#)' else '_' if after.isspace() else 'a'}",
    ]
    if kind == "card":
        names.append(f"luhn={luhn(digits)}")
    if kind == "ip":
        names += [f"octets={octets(groups)}", f"dots={sum(t == '.' for t in tokens)}"]
    if kind == "email":
        low = [t.lower() for t in tokens]
        names += [f"at={'@' in low}", f"word_at={low.count('at')}", f"word_dot={low.count('dot')}", f"label={low[-1] in LAST_LABELS}"]
        names.append(f"cut={beside(all_tokens, i - 1, -1) in JOINTS},{beside(all_tokens, j, 1) in JOINTS}")
    return [f"{kind}:{n}" for n in names]


class SemiMarkov:
    """Weights of segment features. A token outside entities is a segment of its own with score 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def segments(self, tokens: list[str]) -> list[tuple[int, int, str, list[str]]]:
        """Candidate segments (start, end, kind, features), by start; at most LONGEST tokens each."""
        out = []
        for i, first in enumerate(tokens):
            if first.isspace() or not (first[0].isalnum() or first[0] in "+("):
                continue
            before = tokens[i - 1][-1] if i else " "
            if before.isalnum():
                continue
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                if tokens[j - 1] == "\n":
                    break
                if not tokens[j - 1][0].isalnum():
                    continue
                for kind in kinds_of(tokens[i:j]):
                    out.append((i, j, kind, features(kind, tokens, i, j)))
        return out

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def best(self, tokens: list[str], threshold: float = 0.0) -> list[tuple[int, int, str]]:
        """The segmentation of highest score: boundaries and kinds are chosen together by dynamic programming over ends."""
        segments = self.segments(tokens)
        by_end = defaultdict(list)
        for i, j, kind, names in segments:
            s = self.score(names)
            if s > threshold:
                by_end[j].append((i, kind, s))
        best, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            top, link = best[j - 1], None
            for i, kind, s in by_end.get(j, ()):
                if best[i] + s > top:
                    top, link = best[i] + s, (i, kind)
            best.append(top)
            back.append(link)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def train(self, examples: list[tuple[list[str], set[tuple[int, int, str]]]], epochs: int, rate: float, decay: float) -> None:
        """Ascent on the log likelihood of the given segmentations: observed minus expected features, by forward and backward sums."""
        weights: dict[str, float] = defaultdict(float, self.weights)
        prepared = [(len(tokens), self.segments(tokens), gold) for tokens, gold in examples]
        for epoch in range(epochs):
            step = rate / (1 + 0.5 * epoch)
            for n, segments, gold in prepared:
                if not segments:
                    continue
                scores = [sum(weights[f] for f in names) for *_, names in segments]
                starts, ends = defaultdict(list), defaultdict(list)
                for k, (i, j, _, _) in enumerate(segments):
                    starts[i].append(k)
                    ends[j].append(k)
                forward = [0.0] * (n + 1)
                for j in range(1, n + 1):
                    forward[j] = log_sum([forward[j - 1], *(forward[segments[k][0]] + scores[k] for k in ends[j])])
                backward = [0.0] * (n + 1)
                for i in range(n - 1, -1, -1):
                    backward[i] = log_sum([backward[i + 1], *(backward[segments[k][1]] + scores[k] for k in starts[i])])
                for k, (i, j, kind, names) in enumerate(segments):
                    p = math.exp(min(0.0, forward[i] + scores[k] + backward[j] - forward[n]))
                    push = step * (((i, j, kind) in gold) - p)
                    if abs(push) > 1e-4:
                        for f in names:
                            weights[f] += push - step * decay * weights[f]
        self.weights = dict(weights)


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def disguises(kind: str, text: str, k: int) -> list[str]:
    """Ways of writing a span that the base patterns miss; k varies them."""
    if kind == "email":
        name, _, host = text.partition("@")
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" AT ", " DOT "))[k % 4]
        label, _, rest = host.partition(".")
        part = (host, label + "-" + str(k % 10) + dot + rest.replace(".", dot), dot.join(host.rsplit(".", 1)))[k // 4 % 3]
        return [name.replace(".", dot) + at + host.replace(".", dot), name + at + part, name + " @ " + host]
    if kind == "phone":
        bare = text.lstrip("+")
        return [bare.partition(" ")[2] or bare, bare.replace(" ", ".").replace("(", "").replace(")", "")]
    if kind == "ip":
        return [text.replace(".", " . "), text.replace(".", "[.]")]
    d = digits_of(text)
    sep = (".", "/", "_")[k % 3]
    return [sep.join(d[i : i + 4] for i in range(0, len(d), 4))]


def examples_of(texts: list[str]) -> list[tuple[list[str], set[tuple[int, int, str]]]]:
    """Labelled windows: spans of the base patterns as found, the same in disguise, and with digits that make them wrong."""
    out = []
    for k, text in enumerate(texts):
        spans = base_spans(text)
        for a, b in windows(text):
            inside = sorted((s, e, kind) for kind, s, e in spans if a <= s and e <= b)
            inside = [x for n, x in enumerate(inside) if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] and (y[1] - y[0] > x[1] - x[0] or m < n) for m, y in enumerate(inside))]
            versions = [(text[a:b], [(s - a, e - a, kind) for s, e, kind in inside])]
            for n, (s, e, kind) in enumerate(inside):
                old = text[s:e]
                changed = [(new, kind) for new in disguises(kind, old, k + n)]
                if kind == "card":
                    changed.append((old[:-1] + str((int(old[-1]) + 1 + k % 8) % 10), None))
                elif kind == "email":
                    changed.append((("looked at the dot on", "at a dot in", "meets at noon dot to")[k % 3], None))
                    changed.append((("met at home. The", "look at it. We", "was at school. But", "at best. In", "aimed at men.It")[(k + n) % 5], None))
                elif kind == "ip":
                    changed.append((f"{300 + k % 600}.{old.partition('.')[2]}", None))
                for new, now in changed:
                    gold = [(x - a, y - a, z) if y <= s else (x - a + len(new) - e + s, y - a + len(new) - e + s, z) for x, y, z in inside if y <= s or x >= e]
                    versions.append((text[a:s] + new + text[e:b], gold + [(s - a, s - a + len(new), now)] * (now is not None)))
            for part, gold in versions:
                tokens, at, place = [m[0] for m in TOKEN.finditer(part)], {}, 0
                for n, t in enumerate(tokens):
                    at[place] = n
                    place += len(t)
                at[place] = len(tokens)
                out.append((tokens, {(at[s], at[e], kind) for s, e, kind in gold if s in at and e in at}))
    return out


#: Texts that can serve as examples have a run of digits and marks, or an at sign.
HAS_EXAMPLE = r"[0-9][0-9(). -]{5,}[0-9]|@"


def fit(
    docs: DataFrame, *, sample: int = 400, windows_each: int = 4, most_chars: int = 400, epochs: int = 5, rate: float = 0.5, decay: float = 0.001, id_col: str = "doc_id", text_col: str = "text"
) -> SemiMarkov:
    """A model from at most `sample` documents that have a digit run or an at sign, the first by a hash of id and text.

    Rows are hashed first, and only those under a limit of the hash are searched; it is raised until they hold enough, so what
    reaches the driver doesn't grow with the table. Of a document at most windows_each windows are used, of a window at most
    most_chars characters. Without such documents the model is empty and adds nothing.
    """
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 40) - 1)).alias("h"), F.col(text_col).alias("text"))
    share = min(1.0, 40 * sample / max(1, docs.count()))
    while True:
        found = rows.where((F.col("h") < int(share * (1 << 40))) & F.col("text").rlike(HAS_EXAMPLE))
        if share == 1.0 or found.select("h").distinct().count() >= sample:
            break
        share = min(1.0, 10 * share)
    parts = F.slice(F.regexp_extract_all("text", F.lit(rf"(?s).{{0,64}}(?:{HAS_EXAMPLE}).{{0,64}}"), F.lit(0)), 1, windows_each)
    some = found.groupBy("h").agg(F.first(F.transform(parts, lambda x: F.substring(x, 1, most_chars))).alias("parts"))
    texts = [p for r in some.orderBy("h").limit(sample).collect() for p in r["parts"]]
    model = SemiMarkov()
    model.train(examples_of(texts), epochs, rate, decay)
    model.weights = {f: w for f, w in model.weights.items() if abs(w) > 1e-3}
    return model


def added_spans(text: str, base: list[Span], model: SemiMarkov, threshold: float) -> list[Span]:
    """Spans of the best segmentation of the text that no base span overlaps; only its regions have segments."""
    out = []
    if model.weights:
        for a, b in regions(text):
            tokens = [m[0] for m in TOKEN.finditer(text, a, b)]
            starts = [a]
            for t in tokens:
                starts.append(starts[-1] + len(t))
            for i, j, kind in model.best(tokens, threshold):
                s, e = starts[i], starts[j]
                if not any(s < y and x < e for _, x, y in base):
                    out.append((kind, s, e))
    return out


def find_pii(docs: DataFrame, model: SemiMarkov | None = None, *, threshold: float = 1.0, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of base spans), base_spans and spans (arrays of struct kind, start, end).

    start and end are code points, end exclusive. spans holds the base spans and those that the model adds, by kind and start;
    a segment must score above `threshold` to be added. redact replaces each span in text_col by its kind in angle brackets.
    Without a model given, one is fitted on docs (see fit).

    A null text is empty and has no spans (redact leaves it null). Repeated rows get the same result each. Columns of docs that
    have a result's name are replaced. Narrow: no shuffle.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    weights = model.weights
    results = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
    own = [c for c in docs.columns if c not in results]
    at = own.index(text_col)
    span = "array<struct<kind:string,start:long,end:long>>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiMarkov(weights)
        order = {kind: k for k, kind in enumerate(KINDS)}
        for part in slices(batches, text_col):
            texts = part.column(at).to_pylist()
            based = [sorted(base_spans(t), key=lambda s: (order[s[0]], s[1])) if t else [] for t in texts]
            every = [sorted(b + added_spans(t, b, crf, threshold), key=lambda s: (order[s[0]], s[1])) if t else [] for t, b in zip(texts, based, strict=True)]
            columns = [part.column(k) for k in range(len(own))]
            if redact:
                columns[at] = pa.array([redacted(t, s) for t, s in zip(texts, every, strict=True)], part.column(at).type)
            counts = [pa.array([sum(s[0] == kind for s in b) for b in based], pa.int64()) for kind in KINDS]
            listed = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in side], span_type) for side in (based, every)]
            yield pa.RecordBatch.from_arrays([*columns, *counts, *listed], names=[*own, *results])

    kept = docs.select(*own)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, n_email long, n_ip long, n_card long, n_phone long, base_spans {span}, spans {span}")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by <kind>; of spans that overlap, the first and longest names the place."""
    if not spans:
        return text
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, counts, base_sha256 and spans as text: kind:start:end, comma-joined."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(F.col(id_col), "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))

