"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

Base spans come from four fixed patterns, scanned in linear time. The field sees
words (runs without ASCII white space) through features of their shape and those
of their neighbours; it is trained from a small labelled table and decoded by
Viterbi in numpy batches. A word whose score for "outside" beats every other tag
by more than transitions could give back is outside on any best path, so only the
runs of the other words need decoding; the result is the same as for whole texts.

Defined results: a null text counts as empty and has no spans; texts are read
whole; repeated rows are searched each; an empty table gives no rows; other
columns are untouched. Spans are in code points, end exclusive. A span of the field that
meets a base span, or fails its kind's check of digits, is dropped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from siltstone.llm.common import bounded_batches, table

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("outside", *KINDS)
#: Labelled rows that training reads at most.
TRAINING_ROWS = 5000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Of each @ the longest local part to its left; what fails for it fails for any shorter one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- features -------------------------------------------------------------------------------------

_SHAPE = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
_QUOTES = (b'"', b"'")
_CODE = re.compile(rb"[0-9A-Za-z+/_-]{12,}")


def features(word: bytes) -> tuple[str, ...]:
    """Names of a word's features; they depend on its shape alone, and on all of it.

    A shape is told by its first and last runs of equal kinds of characters and by
    how many runs there are, so that it is of bounded length for any word.
    """
    core = word.strip(b".,;:!?\"'()[]{}<>")
    runs, inner = _RUNS.sub(rb"\1", word.translate(_SHAPE)), _RUNS.sub(rb"\1", core.translate(_SHAPE))
    ends = lambda x: (x if len(x) <= 10 else x[:5] + b"~" + x[-4:]).decode("latin-1")
    digits = sum(map(core.count, b"0123456789"))
    code = max((m.group() for m in _CODE.finditer(core)), key=len, default=b"")
    letters, numbers = any(b >= 65 for b in code), any(48 <= b <= 57 for b in code)
    return (
        f"shape {ends(runs)}",
        f"inner {ends(inner)}",
        f"runs {np.searchsorted([2, 3, 4, 6, 8, 12, 20], len(inner), 'right')}",
        f"digits {np.searchsorted([1, 2, 4, 5, 9, 13, 20], digits, 'right')}",
        f"length {np.searchsorted([2, 4, 9, 16, 31], len(core), 'right')}",
        f"at {b'@' in core}",
        f"sign {word in (b'=', b':', b':=')}",
        f"ends in sign {word[-1:] in (b'=', b':')}",
        f"sets {b'=' in core or b':' in core[:-1]}",
        f"quoted {word[:1] in _QUOTES} {word.rstrip(b'.,;')[-1:] in _QUOTES}",
        f"dots {min(core.count(b'.'), 4)}",
        f"code {min(len(code) // 6, 6) if letters and numbers else 0}",
    )


# --- the labelled table ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def labelled_examples(n: int = 700, seed: int = 11) -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    """(words, tags) rows made by rule: invented prose around values of each kind, and look-alikes that are none."""
    r = random.Random(seed)
    letters, codes = "abcdefghijklmnopqrstuvwxyzéüñ", "0123456789abcdef"
    plain = lambda: "".join(r.choice(letters) for _ in range(r.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 18))))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    code = lambda: "".join(r.choice(codes) for _ in range(r.choice((16, 18, 20, 24, 32, 40))))

    def prose() -> str:
        w = plain()
        w = r.choice((w, w, w, w, w, w.capitalize(), w.upper()))
        return w + r.choice(("", "", "", "", "", ".", ",", "!", "?", "!!", ":", "%%%", "###", "$$$", "&&&", "***", "…"))

    def value(kind: str) -> list[tuple[str, str]]:
        end = r.choice(("", "", ".", ","))
        if kind == "email":
            return [(f"{plain()}{r.choice(('', '.', '_'))}{num(2)}@{r.choice(('mail', 'post', ''))}{num(1)}x.{r.choice(('example.com', 'org', 'net'))}{end}", kind)]
        if kind == "ip":
            return [(".".join(str(r.randrange(256)) for _ in range(4)) + end, kind)]
        if kind == "card":
            whole = num(16)
            return r.choice(([(whole + end, kind)], [("-".join((whole[:4], whole[4:8], whole[8:12], whole[12:])), kind)], [(whole[i : i + 4], kind) for i in (0, 4, 8, 12)]))
        if kind == "phone":
            return r.choice(([(f"+{num(1)}", kind), (f"({num(3)})", kind), (f"{num(3)}-{num(4)}{end}", kind)], [(f"+{num(11)}{end}", kind)], [(f"+{num(2)}", kind), (num(3), kind), (num(7), kind)]))
        name, q = r.choice((plain(), f"{plain()}_{plain()}", plain().upper())), r.choice(("", '"', "'"))
        return r.choice(([(f"{name}={q}{code()}{q}{end}", kind)], [(name, "outside"), (r.choice("=:"), "outside"), (f"{q}{code()}{q}{end}", kind)], [(f"{name}:", "outside"), (f"{q}{code()}{q}", kind)]))

    def lookalike() -> list[tuple[str, str]]:
        return r.choice((
            [(num(r.choice((1, 2, 3, 4, 4, 5, 6, 8, 10))) + r.choice(("", ".", ",")), "outside")], [(f"{num(1)}.{num(2)}", "outside")], [(f"{num(4)}-{num(2)}-{num(2)}", "outside")],
            [(plain(), "outside"), (r.choice("=:"), "outside"), (f'"{plain()}"', "outside")], [("=", "outside")], [(f'{plain()}="{plain()}"', "outside")], [("|", "outside")], [(f"{plain()}={num(1)}", "outside")], [(f"{plain()}:{plain()}", "outside")],
            [(f"{num(1)}.{num(1)}.{num(1)}", "outside")], [(f"({num(4)})", "outside")], [(f"+{num(1)}", "outside")], [(f"{num(2)}:{num(2)}:{num(2)}", "outside")], [(f"{num(2)}%", "outside")],
            [(plain() + plain() + plain() + plain(), "outside")], [(f"#{num(3)}", "outside")], [(f"@{plain()}", "outside")], [("//", "outside"), (f"{plain()}({plain()});", "outside")], [(f"{plain()}-{num(3)}", "outside")],
            [(f"http://{plain()}.{plain()}/{plain()}", "outside")],
        ))

    rows = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        while len(row) < 14:
            row += [(prose(), "outside")] if r.random() < 0.62 else lookalike() if r.random() < 0.5 else value(r.choice(KINDS))
        rows.append((tuple(w for w, _ in row), tuple(t for _, t in row)))
    return tuple(rows)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(list(w), list(t)) for w, t in labelled_examples()], "words array<string>, tags array<string>")


# --- the field ------------------------------------------------------------------------------------


class Field:
    """Weights of a linear chain: a word's features on its own tag and on its neighbours', and tag pairs.

    A row is scored as if "outside" stood before and after it.
    """

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.own, self.on_next, self.on_last = (np.zeros((len(names), len(TAGS))) for _ in range(3))
        self.pair = np.zeros((len(TAGS), len(TAGS)))

    def rows_of(self, feats: list[tuple[str, ...]]) -> np.ndarray:
        phi = np.zeros((len(feats), len(self.names)))
        for i, fs in enumerate(feats):
            for f in fs:
                if (j := self.names.get(f)) is not None:
                    phi[i, j] = 1
        return phi

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.3, decay: float = 2e-4) -> Field:
        """Maximum likelihood with a penalty on squares, by full-batch adaptive steps."""
        rows = [(w, t) for w, t in rows if w]
        feats = [[features(x.encode()) for x in w] for w, _ in rows]
        field = cls({f: i for i, f in enumerate(sorted({f for fs in feats for x in fs for f in x}))})
        n, most, k = len(rows), max(map(len, feats), default=0), len(TAGS)
        if not n:
            return field
        phi, gold, mask = np.zeros((n, most + 2, len(field.names))), np.zeros((n, most + 2), int), np.zeros((n, most + 2), bool)
        for i, (fs, (_, tags)) in enumerate(zip(feats, rows, strict=True)):
            phi[i, 1 : len(fs) + 1] = field.rows_of(fs)
            gold[i, 1 : len(fs) + 1] = [TAGS.index(t) for t in tags]
            mask[i, 1 : len(fs) + 1] = True
        hot = np.eye(k)[gold]
        params = [field.own, field.on_next, field.on_last, field.pair]
        seen = [np.full(p.shape, 1e-8) for p in params]
        for _ in range(rounds):
            e = np.where(mask[..., None], phi @ field.own + np.roll(phi @ field.on_next, 1, 1) + np.roll(phi @ field.on_last, -1, 1), np.where(np.arange(k) == 0, 0.0, -50.0))
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, most + 2):
                x = fwd[:, t - 1, :, None] + field.pair
                top = x.max(1)
                fwd[:, t] = e[:, t] + top + np.log(np.exp(x - top[:, None]).sum(1))
            for t in range(most, -1, -1):
                x = (bwd[:, t + 1] + e[:, t + 1])[:, None, :] + field.pair
                top = x.max(2)
                bwd[:, t] = top + np.log(np.exp(x - top[..., None]).sum(2))
            z = fwd[:, -1] + bwd[:, -1]
            z = z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
            p = np.exp(fwd + bwd - z[:, None, None])
            gap = np.where(mask[..., None], hot - p, 0)
            both = np.exp(fwd[:, :-1, :, None] + field.pair + (bwd[:, 1:] + e[:, 1:])[:, :, None, :] - z[:, None, None, None])
            live = (mask[:, :-1] | mask[:, 1:])[..., None, None]
            pairs = np.where(live, hot[:, :-1, :, None] * hot[:, 1:, None, :] - both, 0).sum((0, 1))
            flat = phi.reshape(-1, phi.shape[2])
            steps = [flat.T @ np.roll(gap, s, 1).reshape(-1, k) for s in (0, -1, 1)] + [pairs]
            for w, g, s in zip(params, steps, seen, strict=True):
                g = g / n - decay * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return field

    def best(self, e: np.ndarray) -> np.ndarray:
        """Viterbi over a batch of runs of one length (runs, length, tags), each between two outside words."""
        n, most, k = e.shape
        score, back = e[:, 0] + self.pair[0], np.zeros((n, most, k), np.int8)
        for t in range(1, most):
            x = score[:, :, None] + self.pair
            back[:, t] = x.argmax(1)
            score = x.max(1) + e[:, t]
        out = np.zeros((n, most), np.int8)
        out[:, -1] = (score + self.pair[:, 0]).argmax(1)
        for t in range(most - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out

    def give_back(self) -> np.ndarray:
        """For each tag, the most that transitions can gain by it in place of outside."""
        t = self.pair
        gain = (t - t[:, :1]).max(0) + (t.T - t[0][:, None]).max(0)
        gain[0] = 0
        return gain


class Tagger:
    """Tags of many texts' words at once; remembers the class of a bounded number of words."""

    LIMIT = 400_000

    def __init__(self, field: Field):
        self.field, self.margin = field, field.give_back()
        self._forget()

    def _forget(self) -> None:
        self.word_class: dict[bytes, int] = {}
        self.by_shape: dict[bytes, tuple[str, ...]] = {}
        self.classes: dict[tuple[str, ...], int] = {(): 0}
        self.tables = [np.zeros((1, len(TAGS))) for _ in range(3)]

    def _learn(self, words: set[bytes]) -> None:
        fresh, known = [], self.by_shape
        for w in words:
            shape = w.translate(_SHAPE)
            alone = b"9" in shape  # else the shape says all
            fs = features(w) if alone else known.get(shape) or known.setdefault(shape, features(w))
            c = self.classes.get(fs)
            if c is None:
                c = self.classes[fs] = len(self.classes)
                fresh.append(fs)
            self.word_class[w] = c
        if fresh:
            phi = self.field.rows_of(fresh)
            self.tables = [np.concatenate([t, phi @ w]) for t, w in zip(self.tables, (self.field.own, self.field.on_next, self.field.on_last), strict=True)]

    def tag(self, texts: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """For each text, (word's place, tag) of its words that are not outside."""
        flat: list[bytes] = []
        ends = []
        for words in texts:
            flat += words
            flat.append(b"")  # an outside word between texts
            ends.append(len(flat))
        if len(self.word_class) > self.LIMIT:
            self._forget()
        self.word_class[b""] = 0
        new = set(flat).difference(self.word_class)
        if new:
            self._learn(new)
        c = np.fromiter(map(self.word_class.__getitem__, flat), np.int32, len(flat))
        e = self.tables[0][c]
        e[1:] += self.tables[1][c[:-1]]
        e[:-1] += self.tables[2][c[1:]]
        unsure = ((e + self.margin)[:, 1:] >= e[:, :1]).any(1) & (c > 0)
        at = np.flatnonzero(unsure)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(at):
            return out
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        starts = at[np.concatenate([[0], cut])]
        lengths = np.diff(np.concatenate([[0], cut, [len(at)]]))
        hits = []
        for n in np.unique(lengths):
            own = starts[lengths == n]
            for part in np.array_split(own, max(1, len(own) * int(n) // 200_000)):
                where = part[:, None] + np.arange(n)
                tags = self.field.best(e[where])
                i, j = np.nonzero(tags)
                hits.append(np.stack([where[i, j], tags[i, j]], 1))
        every = np.concatenate(hits)
        every = every[np.argsort(every[:, 0])]
        text = np.searchsorted(ends, every[:, 0], "right")
        for k, (p, t) in zip(text.tolist(), every.tolist(), strict=True):
            out[k].append((p - (ends[k - 1] if k else 0), t))
        return out


def _holds(kind: int, found: str) -> bool:
    """Whether a span that the field names may be of its kind: numbers must be in range, cards pass Luhn."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == 0:
        return "@" in found
    if kind == 1:
        return bool(_IP.fullmatch(found)) and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in found.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind > 3 or 10 <= len(digits) <= 15


def field_spans(text: str, hits: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind's place, end) of tagged words; neighbours of one tag are one span."""
    if not hits:
        return []
    last, want, places = hits[-1][0], {p for p, _ in hits}, {}
    for i, m in enumerate(_WORD.finditer(text)):
        if i in want:
            places[i] = m.span()
        if i == last:
            break
    spans: list[list[int]] = []
    for p, t in hits:
        if spans and spans[-1][1] == t - 1 and spans[-1][3] == p - 1:
            spans[-1][2:] = [places[p][1], p]
        else:
            spans.append([places[p][0], t - 1, places[p][1], p])
    out = []
    for start, kind, end, _ in spans:
        while end > start and text[end - 1] in ".,;:!?#$%&*\"')]}>":
            end -= 1
        while end > start and text[start] in "\"'([{<":
            start += 1
        if end > start and _holds(kind, text[start:end]) and not any(a < end and start < b for a, _, b in base):
            out.append((start, kind, end))
    return out


def find_personal_data(df: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``all_spans``: arrays of (kind, start, end) by start, then kind.

    The field is trained on the driver from ``TRAINING_ROWS`` labelled rows at most.
    One pass over the rows, without a shuffle.
    """
    rows = [(r.words, r.tags) for r in labelled.select("words", "tags").limit(TRAINING_ROWS).collect()]
    field = df.sparkSession.sparkContext.broadcast(_trained(tuple((tuple(w), tuple(t)) for w, t in rows)))
    names = [c for c in df.columns if c not in ("base_spans", "all_spans")]
    df = df.select(*names)
    span = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
    schema = StructType([*df.schema.fields]).add("base_spans", span).add("all_spans", span)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field.value)
        made = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]
        for batch in bounded_batches(batches, text, 4 << 20):
            texts = [x.as_py() or "" for x in batch.column(batch.schema.get_field_index(text))]
            base = [base_spans(t) for t in texts]
            tags = tagger.tag([t.encode("utf-8", "surrogatepass").split() for t in texts])
            more = [b + field_spans(t, h, b) for t, h, b in zip(texts, tags, base, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(map(made, base)), arrow), pa.array(list(map(made, more)), arrow)], names=[*batch.schema.names, "base_spans", "all_spans"]
            )

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _trained(rows: tuple) -> Field:
    return Field.train([(list(w), list(t)) for w, t in rows])


def _digest(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, labelled_table(spark)).drop("text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_digest("base_spans"), 256).alias("base_sha256"), _digest("all_spans").alias("spans"))
