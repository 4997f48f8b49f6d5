"""Sentence units across languages and scripts: candidate boundaries, classified by a maximum-entropy model.

A candidate is the white space after a closing sign of a sentence (and the quotes and brackets after it), the place
after such a sign in scripts without spaces, and any white space inside Thai text. A blank line always ends a sentence.
The model is fitted on boundaries that are sure by themselves: where texts end and begin, and, against them, marks that
a small letter follows, words that never end a text and words that never begin one. There is no list of abbreviations:
which words go on after a full stop is learned from the texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts on which the model is fitted at most: the first of all distinct ones by a hash; and their characters at most.
TRAINED_ON, TRAINED_LENGTH = 30_000, 5_000
#: Times a word must have stood before a mark to be sure that it never ends a text, and after one to be sure that it
#: never begins one: a name may well begin a sentence, but seldom begins a text.
SEEN, SEEN_AFTER = 12, 25
#: Steps of the fit, and the weight that pulls the features' weights to 0.
STEPS, PULL = 150, 2e-4

# Signs that close a sentence; those that stand for nothing else; those that need no space after them;
# quotes and brackets that close and open.
TERMINAL = ".!?…।॥؟۔。！？｡።፧։။។៕།༎᠃"
SURE = "!?।॥؟۔。！？｡።፧։။។៕༎᠃"
WIDE = "。！？｡"
CLOSERS = "\"'”’“»›」』）)]】》"
PAIRS = {"“": "”", "«": "»", "‘": "’", "„": "“", "‚": "‘", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "【": "】", '"': '"', "‹": "›"}
STOP = re.compile(rf"[{TERMINAL}]+(?:[{re.escape(CLOSERS)}]|\s»)*")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
THAI = re.compile(r"(?<=[฀-๿0-9A-Za-z%)])\s+(?=\S)")
HAS_THAI = re.compile("[฀-๿]")
BEFORE = re.compile(r"[^\s\"'”’“»›「『（(\[«„‘]+$")
AFTER = re.compile(r"[^\s.,;:!?…。，、！？।؟\"”“»)」』]+")
OPEN = re.compile(r"[\"'“«„‘‚「『（(\[¿¡\-–•*—\s]*")

Candidate = tuple[int, int, str, str, str, str, str]


def _masked(text: str) -> list[tuple[int, int]]:
    """Spans inside quotation marks or brackets that are closed in the same paragraph, outermost ones only."""
    out: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        close = PAIRS.get(text[i])
        if close:
            if text[i] in "\"'" and not (i == 0 or text[i - 1].isspace() or text[i - 1] in "([（"):
                i += 1
                continue
            stop = BLANK.search(text, i)
            edge = stop.start() if stop else n
            depth, j = 1, i + 1
            while j < edge:
                if text[j] == close and not (close == "’" and j + 1 < n and text[j + 1].isalpha() and text[j - 1].isalpha()):
                    depth -= 1
                    if not depth:
                        break
                elif text[j] == text[i]:
                    depth += 1
                j += 1
            if j < edge:
                out.append((i + 1, j))
                i = j
        i += 1
    return out


def _token_before(text: str, at: int) -> tuple[str, str]:
    """The token that ends at `at`, and the one before it."""
    m = BEFORE.search(text, max(0, at - 40), at)
    if not m:
        return "", ""
    rest = text[max(0, m.start() - 40) : m.start()].split()
    return m[0], rest[-1] if rest else ""


def _key(text: str, at: int) -> str:
    """What stands at `at`, opening signs left out: a word, or three characters in scripts without spaces."""
    at = OPEN.match(text, at).end()
    m = AFTER.match(text, at)
    word = m[0] if m else text[at : at + 1]
    if not word:
        return ""
    if word[0].isdigit():
        return "0"
    c = ord(word[0])
    return word[:3] if 0x0E00 <= c < 0x0E80 or 0x3040 <= c < 0xA000 or 0xAC00 <= c < 0xD7B0 else word


def _last(word: str) -> str:
    """A word as the end of a sentence: without its marks, numbers as one, Thai by its last four characters."""
    word = word.rstrip(TERMINAL + CLOSERS).lower()
    if word and word[-1].isdigit():
        return "0" if len(word) < 3 else "00"
    return word[-4:] if word and "฀" <= word[-1] < "຀" else word


def candidates(text: str) -> Iterator[Candidate]:
    """(end, start of the next unit, mark, token before, token before that, key of what follows, closing sign)."""
    inside = _masked(text)
    k = 0
    found = [(m.start(), m.end(), m[0]) for m in STOP.finditer(text)]
    if HAS_THAI.search(text):
        found = sorted(found + [(m.start(), m.start(), " ") for m in THAI.finditer(text) if text[m.start() - 1] >= "฀" or text[m.end()] >= "฀"])
    last = -1
    for begin, end, mark in found:
        while k < len(inside) and inside[k][1] < begin:
            k += 1
        if k < len(inside) and inside[k][0] <= begin < inside[k][1]:
            close = inside[k][1]
            if text[begin:close].strip(TERMINAL + CLOSERS + "   "):
                continue  # more follows inside
            end = max(end, close + 1)
        if end <= last:
            continue
        nxt = end
        while nxt < len(text) and text[nxt].isspace():
            nxt += 1
        closing = text[end - 1] if text[end - 1] in CLOSERS and mark != " " else ""
        if nxt >= len(text) or nxt == end and not (set(mark) & set(WIDE)):
            continue
        last = end
        one, two = _token_before(text, begin)
        yield end, nxt, mark[0], one, two, _key(text, nxt), closing


def _shape(key: str, text: str, at: int) -> str:
    c = text[at]
    if c in PAIRS or c in "¿¡•*–—-":
        return "open"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    return "letter" if c.isalpha() else "sign"


class Model:
    """Counts of what begins and ends texts, and the weights of the features."""

    def __init__(self):
        self.begins: Counter = Counter()
        self.follows: Counter = Counter()
        self.ends: Counter = Counter()
        self.stands: Counter = Counter()
        self.weights: dict[str, float] = {}

    def ratio(self, part: Counter, whole: Counter, key: str, own_part: int = 0, own_whole: int = 0) -> str:
        """How often a key does what it is asked for, in five steps; unknown for rare keys.

        own_part and own_whole are the counts that a training row has brought in itself: they don't speak for it.
        """
        p, w = max(0, part[key] - own_part), max(0, whole[key] - own_whole)
        n = p + w
        if n < 4 or not p and n < (SEEN_AFTER if part is self.begins else SEEN):
            return "?"
        r = p / n
        return "0" if not p else "1" if r < 0.03 else "2" if r < 0.12 else "3" if r < 0.3 else "4"

    def unknown(self, text: str, c: Candidate) -> list[str]:
        """What the model would see if it had met none of the words before: in training, for rare words to come."""
        bare = Model()
        return bare.features(text, c)

    def features(self, text: str, c: Candidate, seam: int = 0, inner: int = 0) -> list[str]:
        """What the model sees of a candidate; in training, `seam` or `inner` is 1 for what was counted because of it."""
        end, nxt, mark, one, two, key, closing = c
        last, pair = _last(one), f"{_last(two)} {_last(one)}"
        shape = _shape(key, text, nxt)
        begins, ends, both = self.ratio(self.begins, self.follows, key, seam, inner), self.ratio(self.ends, self.stands, last, seam, inner), self.ratio(self.ends, self.stands, pair, seam, inner)
        size = "0" if not one else "num" if one[-1].isdigit() else f"{min(len(one), 5)}{'A' if one[0].isupper() else 'a'}{'.' if '.' in one else ''}"
        return [
            "bias", f"mark {mark}", f"mark {mark} {closing} {shape}", f"shape {shape}", f"shape {shape} ends {ends}", f"begins {begins}", f"ends {ends}", f"pair {both}",
            f"last {last}", f"two {pair}", f"key {key if self.begins[key] + self.follows[key] - seam - inner >= 4 else shape}", f"size {size}", f"size {size} {shape}", f"begins {begins} ends {ends} pair {both}", f"closing {closing} begins {begins}",
            f"line {chr(10) in text[end:nxt]}",
        ]

    def is_boundary(self, text: str, c: Candidate) -> bool:
        """Whether the model holds a candidate for the end of a sentence."""
        return sum(self.weights.get(f, 0.0) for f in self.features(text, c)) > 0


def fit(texts: list[str]) -> Model:
    """The model fitted on whole prose texts."""
    model = Model()
    texts = [t.strip() for t in texts if t and t.strip()]
    seen = [(t, list(candidates(t))) for t in texts]
    for t, found in seen:
        model.begins[_key(t, 0)] += 1
        for part in BLANK.split(t)[1:]:
            model.begins[_key(part, 0)] += 1
        for part in BLANK.split(t):
            m = STOP.search(part[-6:].rstrip())
            one, two = _token_before(part, len(part.rstrip().rstrip(TERMINAL + CLOSERS + " ")))
            if m or HAS_THAI.search(part[-1:]):
                model.ends.update((_last(one), f"{_last(two)} {_last(one)}"))
        for c in found:
            model.follows[c[5]] += 1
            model.stands.update((_last(c[3]), f"{_last(c[4])} {_last(c[3])}"))
    rows: list[tuple[list[str], int, float]] = []
    for t, found in seen:
        for c in found:
            end, nxt, mark, one, two, key, closing = c
            last, pair = _last(one), f"{_last(two)} {_last(one)}"
            never = any(model.stands[x] >= SEEN and not model.ends[x] for x in (last, pair)) and not closing
            odd = model.follows[key] >= SEEN_AFTER and not model.begins[key]
            if t[nxt].islower() or t[nxt] in ",;:)" or mark in ". " and never or odd:
                rows.append((model.features(t, c, inner=1), 0, 1.0))
                if t[nxt].islower() or t[nxt] in ",;:)":
                    rows.append((model.unknown(t, c), 0, 0.2))
            elif model.begins[key] >= 2 and (mark not in ". " or model.ends[last] >= 2 or len(last) > 4 and last.isalpha()):
                rows.append((model.features(t, c, inner=1), 1, 1.0))
    by_script = defaultdict(list)
    for t, _ in seen:
        by_script[(HAS_THAI.search(t) is not None, ord(t[0]) >> 8, t[-1] in WIDE)].append(t)
    for group in by_script.values():  # a text after another of its script: their seam is a boundary
        for a, b in zip(group, group[1:], strict=False):
            glue = "" if a[-1] in WIDE + "」』”" and ord(b[0]) > 0x2E80 else " "
            tail, head = a[-80:], b[:60]
            if not (a[-1] in TERMINAL + CLOSERS or HAS_THAI.search(a[-1])):
                continue
            joined = tail + glue + head
            for c in candidates(joined):
                if c[1] == len(tail) + len(glue):
                    rows += [(model.features(joined, c, seam=1), 1, 0.5), (model.unknown(joined, c), 1, 0.1)]
    for mark in SURE:  # as marks of scripts that the texts don't hold
        for word in ("Abcd efgh", "Abcd e"):
            t = f"{word}{mark} Xenor"
            rows += [(model.unknown(t, c), 1, 0.5) for c in candidates(t)]
    model.weights = _fitted(rows)
    return model


def _fitted(rows: list[tuple[list[str], int, float]]) -> dict[str, float]:
    """Weights of a logistic regression by gradient descent with adaptive steps."""
    if not rows:
        return {"bias": 1.0}
    names: dict[str, int] = {}
    width = max(len(f) for f, _, _ in rows)
    x = np.zeros((len(rows), width), np.int64)
    for i, (fs, _, _) in enumerate(rows):
        x[i, : len(fs)] = [names.setdefault(f, len(names)) for f in fs]
    y, w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    theta, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    flat, per = x.ravel(), np.repeat(np.arange(len(rows)), width)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(theta[x].sum(1), -30, 30)))
        g = np.bincount(flat, ((p - y) * w)[per], len(names)) / w.sum() + PULL * theta / len(names) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}


def units(text: str, model: Model) -> list[tuple[int, int]]:
    """Offsets [start, end) of the sentences of a prose text, without outer white space."""
    cuts = [(m.start(), m.end()) for m in BLANK.finditer(text)]
    cuts += [(c[0], c[1]) for c in candidates(text) if model.is_boundary(text, c)]
    out, start = [], 0
    for end, nxt in [*sorted(cuts), (len(text), len(text))]:
        part = text[start:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((start + lead, start + len(part.rstrip())))
        start = max(start, nxt)
    return out


def one_unit(kind: str | None) -> bool:
    """Whether a type, however spelled, is a bullet, a table row or a caption."""
    letters = re.sub(r"[^a-z]", "", (kind or "").lower())
    return letters.startswith(("bullet", "tablerow", "caption"))


def train(spans: DataFrame, rows: int = TRAINED_ON) -> Model:
    """A model fitted on at most `rows` distinct prose texts of `spans` (text, type), chosen by a hash.

    The hash is asked before anything is shuffled: an estimate of how many distinct texts there are says up to which
    hash there are enough. Texts of more than TRAINED_LENGTH characters don't teach.
    """
    kind = F.regexp_replace(F.lower(F.coalesce("type", F.lit(""))), "[^a-z]", "")
    prose = spans.where(F.col("text").isNotNull() & (F.length("text") <= TRAINED_LENGTH) & ~kind.rlike("^(bullet|tablerow|caption)")).select("text", F.xxhash64("text").alias("h"))
    n = prose.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if n > rows:
        prose = prose.where(F.col("h") < int(-(1 << 63) + (1 << 64) * min(1.0, 1.2 * rows / n)) if n > 1.2 * rows else F.lit(True))
    return fit([r.text for r in prose.distinct().orderBy("h", "text").limit(rows).collect()])


def split(spans: DataFrame, model: Model) -> DataFrame:
    """(field, span_key, char_start, char_end) for every unit of `spans` (field, span_key, text, type).

    Offsets count code points, the end is exclusive, units carry no outer white space. A bullet, table row or caption
    is one unit; any other type, also null, is prose. Blank and null texts have no unit. Repeated rows repeat their
    units; other columns are ignored. Nothing is shuffled.
    """
    shared = spans.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for field, key, text, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if one_unit(kind):
                    found = [(len(text) - len(text.lstrip()), len(text.rstrip()))] if text.strip() else []
                else:
                    found = units(text, own)
                for a, b in found:
                    for col, x in zip(cols, (field, key, a, b), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["field", "span_key", "char_start", "char_end"])

    whole = spans.where(F.col("text").isNotNull()).select("field", F.col("span_key").cast("bigint"), "text", "type")
    return whole.mapInArrow(run, "field string, span_key bigint, char_start int, char_end int")
