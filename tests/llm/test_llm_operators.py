"""Each operator against a brute-force version, on texts with nulls, empties, repeats, ties and clashing columns."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqweft.llm import bpe, decontaminate, induced, jaccard, licenses, quality, secrets, suffix_dedup, toxicity, warc, webp

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) + str(rng.randrange(30)) for _ in range(n))


def texts(seed=0):
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 5, 40, 120, 300, 900)]
    near = base[3].split()
    near[7] = "changed"
    passage = prose(rng, 110)
    out = [None, "", " \n\t", "one", "\x00\x00", *base, base[3], base[3].upper(), " ".join(near), "lead " + passage + " end", passage, prose(rng, 30) + " " + passage + " " + passage]
    out += [prose(rng, 60) + " " + passage[:500] + " " + prose(rng, 5), "x" * 900, "x" * 399, "x" * 400, "ab" * 500, base[5] * 3, "日本語 😀 " * 80]
    for _ in range(6):  # a family of near copies
        w = base[4].split()
        w[rng.randrange(300)] = "edit"
        out.append(" ".join(w))
    return out


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash", 7) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, id string, n_words int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def on_tables(spark, tmp_path, op, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return op(spark, str(tmp_path))


def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [
        (1, "http://a/", "<p>é</p>"), (2, None, None), (3, "u v", ""), (4, "x", "aa WARC/1.1\r\n bb"), (5, "y", "pre" + fake + fake + "post"), (6, "z", fake), (7, "z\r\n", "aa WARC/1.1\r\n bb"),
        (7, "z", "aa WARC/1.1\r\n bb"), (8, "q", "WARC/1.1\r\n" * 3 + "\r\n\r\n"), (None, "n", "aa WARC/1.1\r\n bb"), (9, "big", "x" * 70000 + fake + "y" * 50000), (10, "w", "\r\n\r\nabc"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"id": F.lit("clash"), "payload": F.lit(1)})
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        top = max(q for q, _, x in pages if (x or "") == (h or "") and q is not None)
        revisit = p is None or p < top
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    got = on_tables(spark, tmp_path, warc.op1_warc, pages=df)
    assert rows_of(got) == sorted(want, key=lambda r: (r[0] is None, r))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # chains over several blocks of a file
    try:
        path = f"{tmp_path}/archives"
        warc.write_archives(df.coalesce(1), path, least_bytes=1, compression="none")
        found = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.id for r in found) == sorted("" if p is None else str(p) for p, *_ in pages)
    assert all(r.digest == r.said for r in found if r.type == "response")
    assert sum(r.type == "response" and r.payload_bytes == 0 for r in found) == 2  # below the least size nothing is a revisit


def test_suffix_sorting():
    for seed in range(120):
        r = random.Random(seed)
        depth = r.choice([3, 8, 50, 400])
        body = [r.randint(1, r.choice([1, 2, 3, 20])) for _ in range(r.randint(1, 150))]
        body += body[: r.randint(0, len(body))]
        t = np.array([*body, 0], np.int32)
        order, common = induced.suffixes(t, depth, base_case=r.choice([0, 2, 1000]), limit=r.choice([4, 50, 10000]), block=r.choice([1, 7, 1000]))
        key = [t[i : i + depth].tolist() for i in order.tolist()]
        assert key == sorted(key) and sorted(order.tolist()) == list(range(len(t)))
        for k in range(1, len(t)):
            n = 0
            while n < min(len(key[k]), len(key[k - 1])) and key[k][n] == key[k - 1][n]:
                n += 1
            assert common[k] == n


def test_suffix_dedup(spark, tmp_path):
    rows = texts()
    assert rows_of(on_tables(spark, tmp_path, suffix_dedup.op2_suffix_dedup, documents=docs(spark, rows))) == sorted(suffix_dedup.brute_force(list(enumerate(rows))))
    same = suffix_dedup.dedup(docs(spark, [rows[8]]).union(docs(spark, [rows[8]])))
    assert [len(r.kept) for r in same.collect()] == [0, 0]  # rows that repeat both id and text
    assert suffix_dedup.dedup(docs(spark, rows).limit(0)).count() == 0


def test_suffix_dedup_sorts_only_what_may_match(monkeypatch):
    """Contexts that share 250 or 384 bytes have no string of 400 in common and aren't sorted; those that share 420 are."""
    rng = np.random.default_rng(3)

    def shard(shared):
        core = bytes(rng.integers(97, 122, shared, dtype=np.uint8))
        made = [bytes([65 + i]) * 40 + core + bytes([65 + i]) * (528 - shared) for i in range(5)]
        names = pa.array(range(5), pa.int64())
        return pa.RecordBatch.from_arrays([names, names, pa.array([100] * 5, pa.int32()), pa.array(made, pa.binary())], ["c1", "c2", "back", "context"])

    sizes, plain = [], induced.suffixes
    monkeypatch.setattr(induced, "suffixes", lambda text, *more: sizes.append(len(text)) or plain(text, *more))
    assert [list(suffix_dedup.repeated_starts(iter([shard(n)]))) for n in (250, 384)] == [[], []] and sizes == []
    (out,) = suffix_dedup.repeated_starts(iter([shard(420)]))
    assert out.column("runs").to_pylist() == [[40, 61]] * 5 and sizes[0] < 5 * 450


def test_decontaminate(spark, tmp_path):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (1, 2, 12, 13, 14, 40)] + [None, "", "..."]
    rows = [*texts(), items[5], "x " + items[4].upper() + " y " * 300, items[3] + " " + items[3][:20], items[1] + "!" + items[2], items[0] * 2]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, items[5]])], "item_id long, text string")
    got = on_tables(spark, tmp_path, decontaminate.op3_decontaminate, documents=docs(spark, rows), benchmark=bench)
    want = decontaminate.brute_force(list(enumerate(rows)), list(enumerate([*items, items[5]])))
    assert rows_of(got) == sorted(want)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    small = decontaminate.decontaminate(docs(spark, rows), bench, block_bytes=60)  # several blocks of patterns
    assert [(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in small.orderBy("doc_id").collect()] == [r[:4] for r in sorted(want)]
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(docs(spark, rows).limit(0), bench).count() == 0


def test_decontaminated_rows_are_removed_by_text(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(None, passage), (None, prose(rng, 40)), (None, None), (7, passage), (7, prose(rng, 40)), (8, "")]
    table, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.text) for r in decontaminate.keep(table, items).collect()))) == sorted(str(r) for r in rows if r[1] != passage)


def test_webp_query(spark, tmp_path):
    rows = texts()
    got = {r.doc_id: r for r in on_tables(spark, tmp_path, webp.op4_webp, documents=docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    for r in webp.store(docs(spark, rows)).collect():
        assert got[r.doc_id].media_sha256 == hashlib.sha256(r.media).hexdigest() and got[r.doc_id].media_bytes == len(r.media)
        w, h, argb = webp.decode_one(webp.chunk(bytes(r.media)))  # the plain decoder agrees
        assert webp.samples(argb).tobytes()[: got[r.doc_id].payload_bytes] == webp.samples(webp.decode([bytes(r.media)])[0][2]).tobytes()[: got[r.doc_id].payload_bytes]


class Stream(webp.Writer):
    """Writes lossless streams with every feature of the format, for the decoder's tests."""

    def put_code(self, codes, lengths, symbol):
        if np.count_nonzero(lengths) > 1:
            self.put(int(codes[symbol]), int(lengths[symbol]))

    def image(self, pixels, width, main, cache_bits=0, copies=False, groups=None):
        """pixels: ARGB numbers; groups: (step, cells) of prefix-code groups, main images only."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        ops, cache, i = [], {}, 0
        while i < len(pixels):
            d = next((d for d in (1, width, 2, 3, width + 1) if copies and i >= d and pixels[i : i + 3] == pixels[i - d : i - d + 3] and i + 3 <= len(pixels)), 0)
            slot = (webp._HASH * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
            if d:
                n = 3
                while i + n < len(pixels) and pixels[i + n] == pixels[i + n - d] and n < 4000:
                    n += 1
                ops.append(("copy", i, n, d))
            elif cache_bits and cache.get(slot) == pixels[i]:
                ops.append(("cache", i, slot, 0))
                n = 1
            else:
                ops.append(("pixel", i, 0, 0))
                n = 1
            for p in pixels[i : i + n] if cache_bits else ():
                cache[(webp._HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            i += n
        n_groups = 1
        if main:
            self.put(1 if groups else 0, 1)
            if groups:
                step, cells = groups
                self.put(step - 2, 3)
                self.image([c << 8 for c in cells], (width + (1 << step) - 1) >> step, False)
                n_groups = max(cells) + 1

        def prefix(v):
            if v <= 4:
                return v - 1, 0, 0
            e = (v - 1).bit_length() - 2
            c = 2 * e + 2 + ((v - 1) >> e & 1)
            return c, e, (v - 1) - ((2 + (c & 1)) << e)

        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        used = [[np.zeros(s) for s in sizes] for _ in range(n_groups)]

        def group(at):
            if not (main and groups):
                return 0
            step, cells = groups
            return cells[(at // width >> step) * ((width + (1 << step) - 1) >> step) + (at % width >> step)]

        coded = []
        for kind, at, a, b in ops:
            u, p = used[group(at)], pixels[at]
            if kind == "pixel":
                parts = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
            elif kind == "cache":
                parts = [(0, 280 + a, 0, 0)]
            else:
                c, e, x = prefix(a)
                near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(webp._NEAR)))}
                dc, de, dx = prefix(near.get(b, b + 120))
                parts = [(0, 256 + c, e, x), (4, dc, de, dx)]
            for k, s, *_ in parts:
                u[k][s] += 1
            coded.append((group(at), parts))
        tables = []
        for u in used:
            own = []
            for w in u:
                s = np.flatnonzero(w)
                if len(s) <= 1:
                    self.one_symbol(int(s[0]) if len(s) and s[0] < 256 else 0) if not len(s) or s[0] < 256 else self.code_lengths(self.two(w))
                    lengths = (np.arange(len(w)) == (s[0] if len(s) else 0)).astype(int) if not len(s) or s[0] < 256 else self.two(w)
                else:
                    lengths = np.zeros(len(w), np.int32)
                    lengths[s] = webp._huffman(w[s])
                    self.code_lengths(lengths)
                own.append((webp.canonical(lengths), lengths))
            tables.append(own)
        for g, parts in coded:
            for k, s, e, x in parts:
                self.put_code(*tables[g][k], s)
                self.put(x, e)

    @staticmethod
    def two(w):
        out = np.zeros(len(w), np.int32)
        out[[0, int(np.flatnonzero(w)[0])]] = 1
        return out

    def start(self, width, height):
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def picture(seed, width, height, colours):
    r = random.Random(seed)
    known = [r.getrandbits(32) for _ in range(colours)]
    out = []
    for _ in range(width * height):
        out.append(out[-1] if out and r.random() < 0.5 else r.choice(known))
    return out


@pytest.mark.parametrize("seed", range(14))
def test_webp_features(seed):
    r = random.Random(seed)
    width, height = r.randint(1, 40), r.randint(1, 30)
    colours = r.choice([1, 2, 3, 12, 16, 17, 200])
    want = picture(seed, width, height, colours)
    s = Stream()
    s.start(width, height)
    pixels, x, todo = want, width, [k for k in (0, 1, 2) if r.random() < 0.7]
    if seed % 2 and colours <= 200:  # a palette comes first and last
        s.put(1, 1)
        s.put(3, 2)
        known = sorted(set(pixels))
        s.put(len(known) - 1, 8)
        deltas = [known[0]] + [webp._each(lambda a, b: a - b, p, q) for q, p in zip(known, known[1:], strict=False)]
        s.image(deltas, len(known), False)
        step = 3 if len(known) <= 2 else 2 if len(known) <= 4 else 1 if len(known) <= 16 else 0
        packed = (width + (1 << step) - 1) >> step
        index, bits = {p: i for i, p in enumerate(known)}, 8 >> step
        made = [0] * (packed * height)
        for i, p in enumerate(pixels):
            k = i % width
            made[i // width * packed + (k >> step)] |= index[p] << (bits * (k & ((1 << step) - 1))) << 8
        pixels, x = [p | 0xFF000000 for p in made], packed
    for k in todo:
        s.put(1, 1)
        s.put(k, 2)
        step = r.randint(2, 4)
        cells = ((x + (1 << step) - 1) >> step) * ((height + (1 << step) - 1) >> step)
        if k == 0:
            s.put(step - 2, 3)
            modes = [(seed + i) % 14 for i in range(cells)]
            s.image([m << 8 for m in modes], (x + (1 << step) - 1) >> step, False)
            pixels = webp.add_prediction(pixels, x, modes, step, -1)
        elif k == 1:
            s.put(step - 2, 3)
            elements = [r.getrandbits(24) | 0xFF000000 for _ in range(cells)]
            s.image(elements, (x + (1 << step) - 1) >> step, False)
            pixels = webp.add_colour(pixels, x, elements, step, -1)
        else:
            pixels = [(p & 0xFF00FF00) | (((p >> 16) - (p >> 8)) & 255) << 16 | (p - (p >> 8)) & 255 for p in pixels]
    s.put(0, 1)
    step = 3
    cells = [r.randrange(3) for _ in range(((x + 7) >> 3) * ((height + 7) >> 3))]
    s.image(pixels, x, True, cache_bits=r.choice([0, 3, 10]), copies=seed % 3 > 0, groups=(step, cells) if seed % 4 == 1 else None)
    data = s.bytes()
    file = b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data
    w, h, argb = webp.decode([file])[0]
    assert (w, h) == (width, height) and argb.tolist() == want


def test_webp_wide_and_broken():
    n = 1 << 20
    big = np.arange(n + 64, dtype=np.int64).astype(np.uint8)
    w, h, argb = webp.decode(webp.encode([big]))[0]
    assert w == 32 and webp.samples(argb).reshape(-1)[: len(big)].tobytes() == big.tobytes()
    file = webp.encode([np.zeros(6400, np.uint8)])[0]
    with pytest.raises(ValueError):
        webp.decode([file[:20] + b"\0" * 30])


def kinds(file):
    """Transforms of a stream, and whether its image has back-references, as the plain decoder meets them."""
    found, plain = set(), webp._number

    def number(bits, code):
        found.add("reference")
        return plain(bits, code)

    def stop(*_):
        return [None]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(webp, "_number", number)
        patch.setattr(webp, "_walk", stop)
        for name in ("add_prediction", "add_colour"):
            patch.setattr(webp, name, lambda *a, own=getattr(webp, name), name=name: found.add(name) or own(*a))
        w, h, argb = webp.decode_one(webp.chunk(file))
    return found, webp.samples(argb).tobytes()


def test_webp_encoder_uses_the_format():
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 64 * 40).astype(np.uint8)
    y, x = np.divmod(np.arange(16 * 2000), 16)
    wave = np.stack([120 + 60 * np.sin(y / 90 + k) + 3 * x for k in range(4)], 1) + rng.integers(0, 3, (len(x), 4))
    base = rng.integers(-90, 90, len(x))
    mixed = np.stack([base * 3 // 4 + rng.integers(0, 3, len(x)), base, base // 2 + rng.integers(0, 3, len(x)), 0 * base], 1)
    few = rng.integers(0, 256, (6, 4)).astype(np.uint8)[rng.integers(0, 6, 3200)].reshape(-1)
    many = rng.integers(0, 256, (200, 4)).astype(np.uint8)[rng.integers(0, 200, 16 * 500)].reshape(-1)
    grey = np.stack([rng.integers(0, 256, len(x))] * 3 + [rng.integers(0, 256, len(x))], 1).reshape(-1)
    payloads = [np.concatenate([noise, noise]), wave.astype(np.uint8).reshape(-1), mixed.astype(np.uint8).reshape(-1), few, many, grey.astype(np.uint8), np.zeros(64, np.uint8)]
    payloads += [np.frombuffer((" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"], n)).encode() * 40)[: 64 * n], np.uint8) for n in (20, 100, 1000)]
    files = webp.encode(payloads)
    used = []
    for p, f, (w, h, argb) in zip(payloads, files, webp.decode(files), strict=True):
        found, plain = kinds(f)
        used.append(found)
        assert webp.samples(argb).tobytes() == plain and plain[: len(p)] == p.tobytes()
        assert webp.encode([p]) == [f]
    assert "reference" in used[0] and len(files[0]) < len(noise) * 1.6
    assert "add_prediction" in used[1] and len(files[1]) < len(payloads[1]) / 2
    assert "add_colour" in used[2] and len(files[2]) < len(payloads[2]) / 2
    assert len(files[3]) < 3200 * 3 / 8 + 200 and len(files[4]) < len(payloads[4]) / 3
    bits = webp.Bits(webp.chunk(files[3]))
    assert [bits.read(n) for n in (8, 14, 14, 4, 1, 2, 8)][4:] == [1, 3, 5]  # a palette of six colours
    assert all("reference" in u for u in used[-3:])
    bits = webp.Bits(webp.chunk(files[5]))
    assert "add_colour" not in used[5] and [bits.read(n) for n in (8, 14, 14, 4, 1, 2)][4:] == [1, 2]  # subtract green


def test_bpe_words_leave_the_workers(spark):
    rows = docs(spark, [f"word{i} und noch {i * i} andere" for i in range(200)])
    bpe.digests(rows, bpe.default_path()).collect()

    def kept(batches):
        from seqweft.llm import bpe as own

        for _ in batches:
            for (kind, _), loaded in own._LOADED.items():
                yield pa.RecordBatch.from_pydict({"kind": [kind.__name__], "n": [len(getattr(loaded, "kept", ()))]})

    found = spark.range(0, 64, 1, 16).mapInArrow(kept, "kind string, n long").collect()
    assert found and all(r.n == 0 for r in found)


def test_jaccard_firsts_shuffle_no_prefixes(spark):
    rows = spark.range(3000).selectExpr("id as node", "id % 7 as n", "array(id, id + 1) as prefix")
    own, shared = jaccard._firsts(rows, rows.where("node % 5 <> 0").select("node"))
    assert sorted(r.node for r in own.collect()) == [i for i in range(3000) if i % 5]
    through = jaccard._firsts(rows, rows.select("node"))[0]
    assert through.count() == 3000
    shared.destroy()


def test_jaccard(spark, tmp_path):
    rows = texts()
    got = on_tables(spark, tmp_path, jaccard.op5_jaccard, documents=docs(spark, rows))
    want = sorted(jaccard.brute_force(list(enumerate(rows))))
    assert rows_of(got) == want and len({c for *_, c in want}) < len(want) - 5
    kept = {r.doc_id for r in jaccard.keep_one(docs(spark, rows)).collect()}
    assert kept == {i for i, _, c in want if i == c}
    assert jaccard.linked(docs(spark, rows).limit(0)).count() == 0
    twice = jaccard.linked(docs(spark, [rows[8], rows[9]]).union(docs(spark, [rows[9], rows[8]])))
    assert [(r.doc_id, r.component_id) for r in twice.orderBy("doc_id").collect()] == [(0, 0), (0, 0), (1, 0), (1, 0)]


def test_jaccard_complete_round_alone(spark, monkeypatch):
    """All links are found by the last round alone, with lists of many blocks."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    rng = random.Random(12)
    docs = []
    for g in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(60 + 40 * g)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "one two"), (len(docs) + 3, "ONE two")]
    got = jaccard.linked(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(jaccard.brute_force(docs))


def test_near_duplicates_go_by_row(spark):
    """Ids that repeat, or are null, take no other text with them; of equal rows one stays."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, b), (5, a), (None, " ".join(f"c{i}" for i in range(40))), (None, a + " more"), (7, b), (7, b), (9, ""), (9, ""), (8, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect(), key=str) == sorted([(1, a), (5, b), rows[3], (9, ""), (9, ""), (8, None)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.keep_one(empty).count() == 0 and jaccard.linked(empty).count() == 0


def test_jaccard_chains(spark):
    """Families whose members are linked only through others, and sets at the very threshold."""
    rng = random.Random(9)
    rows, w = [], [f"w{i}" for i in range(200)]
    for k in range(25):
        w = list(w)
        for _ in range(2):
            w[rng.randrange(200)] = f"n{k}-{rng.random()}"
        rows.append(" ".join(w))
    shared = [f"s{i}" for i in range(90)]
    rows += [" ".join([*shared, *(f"t{k}-{i}" for i in range(n))]) for k, n in enumerate([0, 10, 20, 21, 22, 30])]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs(spark, rows)).collect()}
    assert got == {d: (n, c) for d, n, c in jaccard.brute_force(list(enumerate(rows)))}


def labelled(spark, n=400):
    rng = random.Random(6)
    out, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        if bad:
            words = [x.upper() + "!!" for x in words] if i % 2 else [words[0]] * 60
        if toxic:
            words[5:5] = ["nastyword", "vileterm"]
        out.append(" ".join(words))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs(spark, [*out, None, ""]), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("op", "label", "index", "least"), [(quality.op6_quality, "quality", 1, 0.95), (toxicity.op8_toxicity, "toxic", 2, 0.95)])
def test_classifiers(spark, tmp_path, op, label, index, least):
    df, table, labels = labelled(spark)
    got = {r.doc_id: r for r in on_tables(spark, tmp_path, op, documents=df, labels=table).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[x[0]].predicted, x[index]) for x in labels if got[x[0]].held_out]
    assert sum(a == b for a, b in held) >= least * len(held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels(spark, module):
    df, table, _ = labelled(spark, 20)
    label = "quality" if module is quality else "toxic"
    assert {0 <= r.score <= 1 for r in module.score(df, table.limit(0)).collect()} == {True}
    assert module.score(df, table.withColumn(label, F.lit(1))).count() == 22
    assert module.score(df.limit(0), table).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    df, table, _ = labelled(spark, 120)
    other = table.withColumn("toxic", F.when(quality.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(df, t).collect()} for t in (table, other))
    assert a == b


def test_toxic_terms_that_few_examples_share(spark, tmp_path):
    rng = random.Random(8)
    bad = [f"{a}{b}" for a, b in zip("qa wo ze xi vu jy ky".split(), "rrotten slimy brute nasty crook louse creep".split(), strict=True)]
    rows, labels = [], []
    for i in range(480):
        w = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        if i % 7 == 0:
            w[rng.randrange(len(w))] = bad[i // 7 % len(bad)]
        rows.append(" ".join(w))
        labels.append((i, 1, int(i % 7 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in on_tables(spark, tmp_path, toxicity.op8_toxicity, documents=docs(spark, rows), labels=table).collect()}
    held = [(got[d].predicted, y) for d, _, y in labels if got[d].held_out]
    assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held) > 0
    assert sum(1 - p for p, y in held if not y) >= 0.9 * sum(1 - y for _, y in held)


def test_beginnings_leave_words_their_places():
    z, word = np.concatenate([np.full(3 * toxicity.TERMS, 9.0), np.array([4.0, -4.0, 2.0])]), np.arange(3 * toxicity.TERMS + 3) >= 3 * toxicity.TERMS
    keep = toxicity.clear(z, word, 3.0)
    assert keep[word].tolist() == [True, True, False] and keep[~word].sum() == toxicity.TERMS


def secret_rows():
    rng = random.Random(1)
    rows = [None, "", "password: short", 'token = "abcdefgh"', "apikey:abcdefgh1 secret=passwd=12345678", "AKIAABCDEFGH1234", "AKIAABCDEFGH123", "f" * 32 + " " + "f" * 31 + " F", "é AKIA" + "Z" * 20]
    for _ in range(60):
        rows.append(f'{prose(rng, 9)} token = "{rng.getrandbits(160):040x}" {prose(rng, 4)} {rng.randrange(10**15, 10**16)} end')
    return rows


def test_secrets(spark, tmp_path):
    import re

    rows = secret_rows()
    got = {r.doc_id: r for r in on_tables(spark, tmp_path, secrets.op7_secrets, documents=docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    masked = {r.doc_id: r for r in secrets.mask(docs(spark, rows).withColumn("n_chars", F.length("text").cast("long")), "[S]").collect()}
    assert masked[3].text == 'token = "[S]"' and masked[2].text == "password: short" and masked[0].text is None
    assert all(r.n_chars == len(r.text) for r in masked.values() if r.text is not None)


def test_network_learns_from_all_findings(spark, monkeypatch):
    """Every different window of a text is learnt or calibrates, however many there are; several learners share them, and
    the result doesn't depend on how rows lie."""
    rng = random.Random(4)
    text = lambda i: " ".join(f'{prose(rng, 3)} token = "{rng.getrandbits(160):040x}" {prose(rng, 3)} abcdefghij {i + 10**9}' for _ in range(10))
    rows = [text(i) for i in range(60)]
    assert len(secrets.examples(rows[0], secrets.base_spans(rows[0]))) > 10
    found = secrets.candidates(docs(spark, rows), "doc_id", "text")
    seen, plain, scored = [], secrets.trained, secrets.calibrated
    monkeypatch.setattr(secrets, "LEARNER", 400)
    monkeypatch.setattr(secrets, "trained", lambda known, sizes: seen.append(sum(sizes.values())) or plain(known, sizes))
    monkeypatch.setattr(secrets, "calibrated", lambda net, held, recall: seen.append(held.count()) or scored(net, held, recall))
    one = secrets.fit(found)
    total = len({(w, y) for t in rows for w, y in secrets.examples(t, secrets.base_spans(t))})
    assert sum(seen) == total > 2 * 400 and 0 < one.threshold < 1
    other = secrets.fit(found.repartition(7))
    assert all((a == b).all() for a, b in zip(one[:6], other[:6], strict=True)) and abs(one.threshold - other.threshold) < 1e-6


def test_network_finds_secrets_without_a_name(spark):
    """Tokens that no pattern tells, among numbers, names and addresses; the network learns from other texts' findings."""
    import random

    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, both = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = lambda n: " ".join(pick(low, rng.randint(3, 10)) for _ in range(n))
    rows, planted, clean = [], {}, {}
    for i in range(400):
        text = words(30)
        if i % 4 == 0:
            text += f' token = "{pick("0123456789abcdef", 40)}" ' + words(10)
        elif i % 4 == 1:
            planted[i] = (len(text) + 1, len(text) + 41)
            text += " " + pick(both, 40) + " " + words(10)
        elif i % 4 == 2:
            own = rng.choice([pick("0123456789", 16), f"{pick(low, 9)}-{pick(low, 8)}-{rng.randint(1, 99)}", f"2024-01-{rng.randint(10, 28)}-2024-02-17"])
            clean[i] = own
            text += " " + own + " " + words(10)
        rows.append((i, text))
    found = {r["doc_id"]: r["findings"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(any(f["kind"] == "net" and (f["start"], f["end"]) == at for f in found[i]) for i, at in planted.items())
    wrong = sum(bool(found[i]) for i in clean)
    assert hit >= 0.9 * len(planted) and wrong <= 0.1 * len(clean)
    assert all(f["score"] is not None for i in range(0, 400, 4) for f in found[i])


def test_licenses(spark, tmp_path):
    rows = [*texts(), "x\n" + licenses.TEMPLATES[13][1], licenses.TEMPLATES[15][1].replace(". ", ".\n"), "All rights reserved.\nreleased UNDER the mit license", "Licensed under the Apache License, Version 2.0 and more of it"]
    got = {r.doc_id: r for r in on_tables(spark, tmp_path, licenses.op9_licenses, documents=docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        units = t.split("\n") + ([t] if "\n" in t else [])
        found = []
        for u in units:
            own = licenses.bigrams("".join(c.lower() if c.isascii() else c for c in u))
            both = [(2 * len(set(own) & set(licenses.bigrams(x))) / (len(own) + len(licenses.bigrams(x))), n) for n, x in licenses.TEMPLATES]
            if own and max(both)[0] >= licenses.LEAST:
                found.append(max(both))
        found += [(dice, n) for n, dice in windows_by_force(t).items() if n not in {x for _, x in found}]
        assert got[i].n_matches == len(found)
        assert (got[i].best, got[i].best_dice) == ((max(found)[1], pytest.approx(max(found)[0], abs=1e-6)) if found else (None, None))
    assert sum(r.n_matches > 0 for r in got.values()) >= 3


def windows_by_force(text):
    """The best window of each template, none that a better one overlaps, by looking at every place."""
    words = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", "".join(c.lower() if c.isascii() else c for c in text)).split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    tops = []
    for name, body in licenses.TEMPLATES:
        own, places = set(licenses.bigrams(body)), licenses.n_bigrams(body)
        best = None
        for p in range(len(grams)):
            hits = [g for g in grams[p : p + places] if g in own]
            dice = 2 * len(set(hits)) / (places - len(hits) + len(set(hits)) + len(own))
            if grams[p] in own and dice >= licenses.LEAST and (best is None or dice > best[0]):
                best = (dice, name, p, p + places)
        tops += [best] if best else []
    return {n: d for d, n, *_ in sorted(x for x in tops if not any(y[:2] > x[:2] and y[2] < x[3] and x[2] < y[3] for y in tops))}


def test_licences_within_texts(spark):
    import textwrap

    rng = random.Random(4)
    mit, apache, bsd = (licenses.TEMPLATES[k][1] for k in (15, 1, 2))
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(mit, 72)) + "\n" + "\n".join(prose(rng, 9) for _ in range(60))
    header = "\n".join("# " + x for x in textwrap.wrap(apache, 60))
    inline = prose(rng, 50) + " " + licenses.TEMPLATES[14][1] + " " + prose(rng, 50)
    edited = prose(rng, 40) + " " + mit.replace("copies of", "some copies of").replace("substantial", "large") + " " + prose(rng, 40)
    two = prose(rng, 20) + " " + licenses.TEMPLATES[9][1] + " " + prose(rng, 20) + " " + bsd + "\n" + prose(rng, 20)
    nothing = prose(rng, 30) + " under the license of the copies or the software and this permission notice " + prose(rng, 30)
    rows = [wrapped, header + "\n\n" + prose(rng, 80) + "\n" + prose(rng, 40), inline, edited, two, nothing, inline, inline + " " + inline, (prose(rng, 3000) + " of the software or the use ") * 8 + apache, mit[: len(mit) // 4] + prose(rng, 60), None, "", "one"]
    got = {r.doc_id: r.matches for r in licenses.scan(docs(spark, rows)).collect()}
    want = {0: "MIT", 1: "Apache-2.0", 2: "MIT", 3: "MIT", 6: "MIT", 7: "MIT", 8: "Apache-2.0"}
    for i, t in enumerate(rows):
        if i == 1:  # the first line alone is a notice already
            assert [m.name for m in got[i]] == ["Apache-2.0"]
            continue
        assert {m.name: m.dice for m in got[i]} == pytest.approx(windows_by_force(t or ""))
        if i in want:
            assert {m.name for m in got[i]} == {want[i]}
    assert {m.name for m in got[4]} == {"GPL-2.0", "BSD-2-Clause"} and not got[5] and not got[9]
    assert licenses.scan(docs(spark, rows).where("doc_id < 0")).count() == 0
    assert [len(r.matches) for r in licenses.scan(docs(spark, rows), templates=[("short", "one"), ("pair", "one two")]).collect()] == [0] * len(rows)


def test_bpe(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rows = [*texts(), "<|endoftext|>hi <|startoftext|>", "<|endoftext|", "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁ", "á가", "don't I'LL we've x\x1c\x85y", "a" * 3000, "\x00abc\x00<|endoftext|>", "​﻿ 　"]
    got = {r.doc_id: r for r in on_tables(spark, tmp_path, bpe.op10_bpe, documents=docs(spark, rows)).collect()}
    for i, text in enumerate(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    df, table, labels = labelled(spark)
    rng = random.Random(2)
    clean = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    item = clean(20)
    first = df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    more = [clean(50), clean(30) + " " + item, clean(40) + ' token = "abcdefgh12345678" ' + clean(40)]
    more += [more[0] + " end"]
    extra = spark.createDataFrame([(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(more)], first.schema)
    first.union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(read, table).collect()}
    left = corpus_pipeline.quality_stage(spark, read, str(tmp_path))
    assert left.columns == read.columns and {r.doc_id for r in left.collect()} == {d for d, s in scores.items() if s >= 0.7}
    assert {x[0] for x in labels if x[1] == 1} <= {r.doc_id for r in left.collect()}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1003 not in rows and 1001 not in rows and {1000, 1002} <= rows.keys()
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(bpe.default_path()).encode(more[2].replace("abcdefgh12345678", "[SECRET]"), add_special_tokens=False).ids
    assert rows[1002].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
