"""Secret scans: a small character convolutional network over every candidate and its surroundings.

Three patterns give the base findings, which always stay. The network scores them and all further candidates (long strings
with a digit), which it may add. It is trained on all base findings, also with the name before them taken
away and with their characters exchanged, so that a value must be told by itself, against strings of every text that are
surely no secrets: words, numbers, addresses, and words joined to identifiers. Candidates that the patterns don't tell are
never learnt. Where there are many, they are dealt to learners that each train a copy on their part; the copies' mean goes
into the next round. The threshold is the highest one that keeps a given recall on all nameless findings which training
didn't see, after their scores are calibrated.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm._arrow import id_and_text, release, slices, strings, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Further candidates, and strings that training may take as no secrets.
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
PLAIN = re.compile(r"[A-Za-z0-9+/_.=@:-]{8,}", re.ASCII)
#: Strings of a text that may stand for what is no secret, least recall of the threshold, characters before and after and
#: of the candidate that the network sees.
OF_TEXT, RECALL, BEFORE, INSIDE, AFTER = 4, 0.97, 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
_KERNEL, _FILTERS, _EPOCHS = 5, 24, 12
#: Strings that one learner trains on, rounds of several learners, windows that one learner alone sees about, copies summed
#: up in one step.
LEARNER, _ROUNDS, _SEEN, _FAN = 32_768, 4, 96_000, 64

#: Characters by what they are: letters by case and hexadecimal or not, digits, and the signs that stand around values.
_CODE = np.zeros(128, np.uint8)
for _i, _group in enumerate(["", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "\"'", "=", ":", "+/", "-_", ".,", "@", "#$%&*!|"]):
    for _c in _group:
        _CODE[ord(_c)] = _i
_CODES = 18  # and 16 for what is beyond ASCII, 17 for no character


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def further(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long strings with a digit that no base finding overlaps."""
    out = [(m.start(), m.end()) for m in LONG.finditer(text) if any(c.isdigit() for c in m[0])]
    return [(a, b) for a, b in out if not any(x < b and a < y for x, _, y in base)] if out else []


def window(text: str, start: int, end: int) -> bytes:
    """Codes of the characters before, in (first and last part) and after the candidate."""

    def part(a: int, b: int, width: int, right: bool) -> np.ndarray:
        s = text[max(a, 0) : b]
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 128, _CODE[np.minimum(c, 127)], 16).astype(np.uint8)
        out = np.full(width, 17, np.uint8)
        if len(c):
            out[width - len(c) :] = c if right else out[width - len(c) :]
            if not right:
                out[: len(c)] = c
        return out

    half = INSIDE // 2
    own = (start, end) if end - start <= INSIDE else (start, start + half)
    inside = part(own[0], own[1], INSIDE, False)
    if end - start > INSIDE:
        inside[half:] = part(end - half, end, half, False)
    return np.concatenate([part(start - BEFORE, start, BEFORE, True), inside, part(end, end + AFTER, AFTER, False)]).tobytes()


class Net(NamedTuple):
    """One layer of filters, the strongest answer of each before and in the candidate, one hidden layer."""

    kernel: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _forward(self, x)[-1]

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw.astype(np.float64) + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.raw(x))


def _forward(net: Net, x: np.ndarray) -> tuple:
    n = len(x)
    shape = net.kernel.reshape(_KERNEL, _CODES, _FILTERS)
    conv = np.zeros((n, WIDTH - _KERNEL + 1, _FILTERS), np.float32) + net.bias
    for k in range(_KERNEL):
        conv += shape[k][x[:, k : k + WIDTH - _KERNEL + 1]]
    act = np.maximum(conv, 0)
    cut = BEFORE - _KERNEL // 2
    parts = (act[:, :cut], act[:, cut:])
    where = [p.argmax(1) for p in parts]
    pooled = np.concatenate([np.take_along_axis(p, w[:, None], 1)[:, 0] for p, w in zip(parts, where, strict=True)] + [act[:, cut:].mean(1)], 1)
    h = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    return conv, where, pooled, h, h @ net.out + net.out_bias[0]


def _begun(seed: int = 5) -> Net:
    rng, f = np.random.default_rng(seed), np.float32
    return Net(rng.normal(0, 0.2, (_KERNEL * _CODES, _FILTERS)).astype(f), np.zeros(_FILTERS, f), rng.normal(0, 0.2, (3 * _FILTERS, 16)).astype(f), np.zeros(16, f), rng.normal(0, 0.2, 16).astype(f), np.zeros(1, f))


def train(x: np.ndarray, y: np.ndarray, share: np.ndarray, begin: Net, passes: int, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam on the logistic loss, a row weighed by its share."""
    rng = np.random.default_rng(seed)
    f = np.float32
    w = [a.copy() for a in begin[:6]]
    m, v, step, cut = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, BEFORE - _KERNEL // 2
    for _ in range(passes):
        for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xb, yb = x[own], y[own].astype(f)
            conv, where, pooled, h, raw = _forward(Net(*w), xb)
            d = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - yb) * share[own] / len(own)).astype(f)
            dh = np.outer(d, w[4]) * (h > 0)
            dp = dh @ w[2].T
            dc = np.zeros_like(conv)
            rows = np.arange(len(own))[:, None]
            cols = np.arange(_FILTERS)[None]
            dc[rows, where[0], cols] += dp[:, :_FILTERS]
            dc[rows, where[1] + cut, cols] += dp[:, _FILTERS : 2 * _FILTERS]
            dc[:, cut:] += dp[:, None, 2 * _FILTERS :] / (conv.shape[1] - cut)
            dc *= conv > 0
            dk = np.zeros((_KERNEL, _CODES, _FILTERS), f)
            flat = dc.reshape(-1, _FILTERS)
            for k in range(_KERNEL):
                codes = xb[:, k : k + conv.shape[1]].ravel()
                dk[k] = (np.arange(_CODES)[:, None] == codes[None]).astype(f) @ flat
            grads = [dk.reshape(w[0].shape), dc.sum((0, 1)), pooled.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()], f)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                w[i] = (w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(f)
    return Net(*w)


def trained(known: DataFrame, sizes: dict[int, int]) -> Net:
    """A network trained on all rows (x, y, h), as many as `sizes` says of each label; secrets weigh as much as the others.

    Which learner a row goes to depends on its hash, and copies are summed up as whole numbers, so the result doesn't
    depend on how rows lie.
    """
    n = sum(sizes.values())
    learners = -(-n // LEARNER)
    dealt = known.withColumn("k", F.pmod(F.shiftright("h", 8), F.lit(learners)))
    net = _begun()
    shapes = [a.shape for a in net[:6]]
    rounds = 1 if learners == 1 else _ROUNDS
    passes = max(_ROUNDS, min(_EPOCHS, -(-_SEEN // n))) if learners == 1 else 1
    for r in range(rounds):
        begin, rate = net, 0.01 / (r + 1)

        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by("h")
            x = np.stack([np.frombuffer(w, np.uint8) for w in table["x"].to_pylist()])  # noqa: B023
            y = table["y"].to_numpy()
            share = np.where(y > 0, n / 2 / (n - sizes[0]), n / 2 / sizes[0])
            own = train(x, (y > 0).astype(int), share, begin, passes, rate)  # noqa: B023
            flat = np.rint(np.concatenate([a.ravel() for a in own[:6]]).astype(np.float64) * (1 << 24)).astype(np.int64) * len(y)
            return pa.table({"k": table["k"][:1], "data": pa.array([flat.tobytes()], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(d, np.int64) for d in table["data"].to_pylist()], 0)
            return pa.table({"k": pa.array([table["k"][0].as_py() // _FAN], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

        made, left = dealt.groupBy("k").applyInArrow(learn, "k long, data binary"), learners
        while left > _FAN:
            made, left = made.groupBy(F.floor(F.col("k") / _FAN).alias("group")).applyInArrow(add, "k long, data binary"), -(-left // _FAN)
        total = np.sum([np.frombuffer(bytes(row["data"]), np.int64) for row in made.select("data").collect()], 0)
        cuts = np.cumsum([int(np.prod(shape)) for shape in shapes])[:-1]
        net = Net(*(a.reshape(shape).astype(np.float32) for a, shape in zip(np.split(total / (n * float(1 << 24)), cuts), shapes, strict=True)))
        release(known.sparkSession)
    return net


def calibrated(net: Net, held: DataFrame, recall: float) -> Net:
    """Slope and shift by logistic regression on all rows (x, y) that training didn't see; the highest threshold with this
    recall. Sums are of whole numbers, so they don't depend on how rows lie; none but sums and counts reach the driver."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                raw = net.raw(np.stack([np.frombuffer(w, np.uint8) for w in part.column("x").to_pylist()])).astype(np.float32)
                bits = raw.view(np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(bits >= 0, bits, bits ^ 0x7FFFFFFF)), pa.array(raw.astype(np.float64)), part.column("y")], ["key", "raw", "y"])

    scored = written(held.select("x", "y").mapInArrow(score, "key long, raw double, y int"), "scored")
    n, positive = scored.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    raw, yes = F.col("raw"), F.col("y") > 0
    target = F.when(yes, (positive + 1) / (positive + 2)).otherwise(1 / (n - positive + 2))
    whole = lambda c: F.sum(F.round(c * float(1 << 30)).cast("long")) / float(1 << 30)
    here, step, least, at = np.array([1.0, 0.0]), np.zeros(2), np.inf, np.array([1.0, 0.0])
    for _ in range(30):  # Newton's steps, halved where the loss would grow
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(here[0])) * raw + F.lit(float(here[1]))))))
        t = scored.select("raw", (p - target).alias("d"), (p * (1 - p) + 1e-6).alias("s"), (-target * F.log(p) - (1 - target) * F.log(1 - p)).alias("loss"))
        loss, dr, d, srr, sr, s = t.agg(*map(whole, (F.col("loss"), F.col("d") * raw, F.col("d"), F.col("s") * raw * raw, F.col("s") * raw, F.col("s")))).first()
        loss += 5e-4 * (here[0] - 1) ** 2
        if loss < least:
            least, at = loss, here
            step = np.linalg.solve(np.array([[srr + 1e-3, sr], [sr, s + 1e-9]]), np.array([dr + 1e-3 * (at[0] - 1), d]))
        else:
            step = step / 2
        if np.abs(step).max() < 1e-4:
            break
        here = np.array([max(at[0] - step[0], 1e-3), at[1] - step[1]])
    a, b = map(float, at)
    net = net._replace(slope=a, shift=b)
    if not positive:
        return net._replace(threshold=2.0)
    # the value at one place of the order of positive ones, by the upper and then the lower bits of its key

    def bucket(rows: DataFrame, place: int) -> tuple[int, int]:
        for b, many in sorted((r["b"], r["count"]) for r in rows.groupBy("b").count().collect()):
            if place < many:
                break
            place -= many
        return b, place

    high = F.floor(F.col("key") / 65536)
    upper, place = bucket(scored.where(yes).select(high.alias("b")), int((1 - recall) * positive))
    found, _ = bucket(scored.where(yes & (high == upper)).select(F.col("key").alias("b")), place)
    bits = np.array([found if found >= 0 else found ^ 0x7FFFFFFF], np.int64).astype(np.int32)
    return net._replace(threshold=float(net.scaled(bits.view(np.float32))[0]))


_FOUND = "base array<int>, more array<int>, windows array<binary>, label_windows array<binary>, labels array<int>"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def value_of(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The value of a base finding: of an assignment what is assigned."""
    return ASSIGN.match(text, start).span(2) if kind == 0 else (start, end)


def exchanged(value: str) -> str:
    """Letters and digits replaced by others, by a rule of the value alone: what is random stays so, in a larger alphabet."""
    seed = zlib.crc32(value.encode())
    return "".join(_ALPHABET[(seed + 7 * i * i + ord(c) * (seed % 61 + 1) * (i % 5 + 1)) % 62] if c.isalnum() else c for i, c in enumerate(value))


def examples(text: str, base: list[tuple[int, int, int]]) -> list[tuple[bytes, int]]:
    """What can be learnt of a text: windows with label 1 (named finding), 2 (nameless) or 0 (surely no secret)."""
    out = []
    for a, kind, b in base:
        x, y = value_of(text, a, kind, b)
        out.append((window(text, x, y), 1))
        if kind and any(c <= x and y <= d and k == 0 for c, k, d in base):
            continue  # the value of an assignment too
        for value in (text[x:y], exchanged(text[x:y])):
            bare = text[max(0, a - BEFORE) : a] + value
            out.append((window(bare + text[y : y + AFTER], len(bare) - len(value), len(bare)), 2))
    plain = []
    for m in PLAIN.finditer(text):
        own, digit = m[0], any(c.isdigit() for c in m[0])
        if digit and any(c.isalpha() for c in own) and "@" not in own or any(x < m.end() and m.start() < y for x, _, y in base):
            continue  # it might be one
        plain.append((own, m.start(), m.end()))
        if len(plain) == OF_TEXT:
            break
    out += [(window(text, a, b), 0) for _, a, b in plain[:2]]
    if len(plain) > 2:  # words joined to an identifier
        (v, *_), (w, a, b), (_, c, d) = plain[0], plain[1], plain[2]
        seed = zlib.crc32(w.encode())
        name = f"{v}{'-_/'[seed % 3]}{w}{'-_/'[seed % 3]}{seed % 10 ** (seed % 4 + 1)}"
        before = text[max(0, c - BEFORE) : c]
        out.append((window(before + name + text[d : d + AFTER], len(before), len(before) + len(name)), 0))
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: base findings and further candidates as flat (start, kind, end) and (start, end), the windows of both, and
    what can be learnt."""
    source = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i32, raw = pa.list_(pa.int32()), pa.list_(pa.binary())
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            for text in strings(batch.column("text")):
                base = base_spans(text)
                more = further(text, base)
                known = examples(text, base)
                spans = [value_of(text, *x) for x in base] + more
                for col, x in zip(cols, ([v for s in base for v in s], [v for s in more for v in s], [window(text, a, b) for a, b in spans], [w for w, _ in known], [y for _, y in known]), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, (i32, i32, raw, raw, i32), strict=True))], ["id", "base", "more", "windows", "label_windows", "labels"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {_FOUND}")


def fit(found: DataFrame, recall: float = RECALL) -> Net | None:
    """Train on all different windows with their labels; a quarter of those without a name, by hash, calibrates instead."""
    rows = found.select(F.explode(F.arrays_zip("label_windows", "labels")).alias("x")).select(F.col("x.label_windows").alias("x"), F.col("x.labels").alias("y")).distinct()
    known = written(rows.withColumn("h", F.xxhash64("x", "y")), "known")
    quarter = F.pmod("h", F.lit(4)) == 3
    counts = {r["y"]: (r["n"], r["held"]) for r in known.groupBy("y").agg(F.count("*").alias("n"), F.count_if(quarter).alias("held")).collect()}
    if min(counts.get(y, (0, 0))[0] for y in (0, 1, 2)) < 4:
        return None
    few = [y for y, (n, held) in counts.items() if held in (0, n)]  # a handful of rows: every fourth
    split = known.where(~F.col("y").isin(few)).withColumn("last", quarter)
    if few:
        nth = F.row_number().over(Window.partitionBy("y").orderBy("h"))
        split = split.unionByName(known.where(F.col("y").isin(few)).withColumn("last", nth % 4 == 0))
    last = F.col("last") & (F.col("y") != 1)  # thresholds are for values without a name
    learnt = split.where(~last)
    sizes = {r["y"]: r["count"] for r in learnt.groupBy("y").count().collect()}
    return calibrated(trained(learnt.select("x", "y", "h"), sizes), split.where(last), recall)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """Per row: id and findings, an array of (kind, start, end, score) by start, then kind; code points, end exclusive.

    Kinds assign, access and hex are the base findings, which stay whatever their score; net is what the network adds. The
    score is null where no network could be trained. Null and empty texts
    have none; repeated rows are scanned one by one. Where the texts hold too few findings to train on, nothing is added.
    """
    found = written(candidates(docs, id_col, text_col), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(fit(found, recall))
    order = (*KINDS, "net")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Net | None = shared.value
        for batch in batches:
            windows = batch.column("windows").to_pylist()
            flat = [w for ws in windows for w in ws]
            p = iter(np.concatenate([net.probability(np.stack([np.frombuffer(w, np.uint8) for w in flat[i : i + 2048]])) for i in range(0, len(flat), 2048)]).tolist() if flat and net else [None] * len(flat))
            out = []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True):
                spans = [(a, k, b, next(p)) for a, k, b in zip(base[::3], base[1::3], base[2::3], strict=True)]
                for a, b in zip(more[::2], more[1::2], strict=True):
                    s = next(p)
                    if net and s >= net.threshold:
                        spans.append((a, 3, b, s))
                out.append([{"kind": order[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(spans, key=lambda x: x[:3])])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], ["id", "findings"])

    made = found.select("id", "base", "more", "windows").mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, findings array<struct<kind:string,start:int,end:int,score:double>>")
    return made.select(F.col("id").alias(id_col), "findings")


def mask(docs: DataFrame, sign: str, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs; each finding's value is replaced by `sign`, and size_col, where present, follows.

    Of an assignment the name stays. Texts without findings, null ones too, are left as they are.
    """
    found = written(candidates(docs, id_col, text_col), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Net | None = shared.value
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                spans = [value_of(text, *x) for x in base]
                more = further(text, base)
                if more and net:
                    p = net.probability(np.stack([np.frombuffer(window(text, a, b), np.uint8) for a, b in more]))
                    spans += [s for s, x in zip(more, p.tolist(), strict=True) if x >= net.threshold]
                if spans:
                    out, at = [], 0
                    for a, b in sorted(spans):
                        if b <= at:
                            continue
                        out += [text[at:a], sign] if a >= at else []
                        at = b
                    texts[i] = "".join(out) + text[at:]
            cols = {name: batch.column(name) for name in batch.schema.names}
            cols[text_col] = pa.array(texts, cols[text_col].type)
            if size_col in cols:
                cols[size_col] = pa.array([old if t is None else len(t) for t, old in zip(texts, cols[size_col].to_pylist(), strict=True)], cols[size_col].type)
            yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("findings", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    scores = F.array_join(F.transform("findings", lambda s: F.coalesce(F.format_string("%.3f", s["score"]), F.lit(""))), ",")  # of all spans, in their order
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("findings", lambda s: s["kind"] != "net")), 256).alias("base_sha256"), joined("findings").alias("spans"), scores.alias("scores"))
