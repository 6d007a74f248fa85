import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from quillon.llm import decontaminate, sharding, webp


@pytest.mark.parametrize("seed", range(5))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        size, window = rng.choice([2, 3, 6]), rng.choice([2, 3, 4])
        items = [(str(i), " ".join(rng.choice("abcdefgh"[:size]) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(1, 5))]
        doc = [rng.choice("abcdefgh"[:size] + "z").encode() for _ in range(rng.randint(0, 25))]
        spans, found = decontaminate.SuffixAutomaton(items, window).match(doc)
        hit, owners = set(), set()
        for name, text in items:
            words = decontaminate.words_of(text)
            n = min(window, len(words))
            for j in range(len(words) - n + 1 if words else 0):
                for k in range(len(doc) - n + 1):
                    if doc[k : k + n] == words[j : j + n]:
                        hit |= set(range(k, k + n))
                        owners.add(name)
        assert {p for s, e in spans for p in range(s, e)} == hit and found == owners


def test_words_are_ascii_folded_only():
    assert decontaminate.words_of("Été,ÜBER a-B_c\x7f9") == ["Été".encode(), "ÜBER".encode().replace(b"B", b"b").replace(b"E", b"e").replace(b"R", b"r"), b"a", b"b", b"c", b"9"]
    assert decontaminate.words_of(None) == []


def test_decontaminate_cuts_spans_and_drops(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it. {item.upper()}! after " + "x " * 30, 5), (2, item, 5), (3, "clean", 5), (4, None, 5)], "doc_id bigint, text string, n_words int")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, "")], "item_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {1: "Before it. ! after " + "x " * 30, 3: "clean", 4: None}
    assert decontaminate.decontaminate(odd, items).count() == odd.count()
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.decontaminate(empty, items).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x{j}" for i in (2, 5, 0) for j in range(12)))], "doc_id bigint, text string")
    one = decontaminate.find_leaks(docs, items).first()["leak"]
    cut = decontaminate.decontaminate(docs, items, max_coverage=1.0).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    many = decontaminate.find_leaks(docs, items).first()["leak"]
    assert one == many and one["items"] == ["0", "2", "5"]
    assert decontaminate.decontaminate(docs, items, max_coverage=1.0).collect() == cut


def test_an_automaton_takes_few_bytes():
    rng = random.Random(0)
    items = [(str(i), " ".join(f"w{int(rng.paretovariate(0.6)) % 50_000}" for _ in range(200))) for i in range(300)]
    tracemalloc.start()
    automaton = decontaminate.SuffixAutomaton(items)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 60 * sum(len(t) for _, t in items)
    assert automaton.match(decontaminate.words_of("x " + items[7][1] + " y"))[0] == [(1, 201)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert (out != sharding.permute(np.arange(n), n, seed=4)).mean() > 0.9


def test_shards_are_even_gapless_and_repeatable(spark, odd, empty):
    source = spark.range(1003).withColumnRenamed("id", "doc_id")
    rows = sharding.shard(source, ["doc_id"], 16).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(sizes) == 16 and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(source.repartition(7), ["doc_id"], 16).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert sharding.shard(odd.select("doc_id", "text"), ["doc_id", "text"]).count() == odd.count()
    assert sharding.shard(empty.select("doc_id"), ["doc_id"]).count() == 0


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n)]

    def code(self, lengths):
        """Declare a prefix code; gives a function that writes its symbols."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 1:
            symbol = used[0] if used else 0
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbol, 8)
            return lambda s: None
        self.put(0, 1), self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            for k in (3, 2, 1, 0):
                self.put((n >> k) & 1, 1)
        table, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            last = n
            table[s] = (code, n)
            code += 1

        def write(s):
            value, n = table[s]
            for k in range(n - 1, -1, -1):
                self.put((value >> k) & 1, 1)

        return write

    def image(self, pixels, width, main=False, cache_bits=0, back=False):
        """An entropy-coded image; with back-references to the pixel above where they fit."""
        self.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        size = (1 << cache_bits) if cache_bits else 0
        green = [0] * (280 + size)
        total = 256 + 24 + size
        short = (1 << 9) - total
        for s in range(total):
            green[s] = 8 if s < short else 9
        writers = [self.code(green), self.code([8] * 256), self.code([8] * 256), self.code([8] * 256), self.code([1, 1] + [0] * 38)]
        cache, i = {}, 0

        def index(p):
            return ((p * webp.CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)

        while i < len(pixels):
            run = 0
            while back and i >= width and i + run < len(pixels) and pixels[i + run] == pixels[i + run - width] and run < 4:
                run += 1
            p = pixels[i]
            if run >= 1:
                writers[0](256 + run - 1)
                writers[4](0)  # the pixel above
            elif cache_bits and cache.get(index(p)) == p:
                writers[0](280 + index(p))
                run = 1
            else:
                writers[0]((p >> 8) & 255), writers[1]((p >> 16) & 255), writers[2](p & 255), writers[3](p >> 24)
                run = 1
            for k in range(i, i + run):
                if cache_bits:
                    cache[index(pixels[k])] = pixels[k]
            i += run

    def file(self, width, height, body):
        self.put(width - 1, 14), self.put(height - 1, 14), self.put(1, 1), self.put(0, 3)
        body(self)
        data = b"\x2f" + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def picture(seed, width, height, colours=None):
    rng = random.Random(seed)
    table = [rng.getrandbits(32) for _ in range(colours)] if colours else None
    return [rng.choice(table) if table else rng.getrandbits(32) for _ in range(width * height)]


@pytest.mark.parametrize(("cache", "back"), [(0, False), (4, False), (0, True), (6, True)])
@pytest.mark.parametrize(("width", "height"), [(7, 9), (31, 40)])
def test_prefix_codes_references_and_cache(monkeypatch, width, height, cache, back):
    pixels = picture(1, width, height, 5)

    def body(w):
        w.put(0, 1)
        w.image(pixels, width, True, cache, back)

    file = Writer().file(width, height, body)
    assert webp.decode_image(file)[0].ravel().tolist() == pixels
    monkeypatch.setattr(webp, "SEGMENT", 32)
    assert webp.decode_image(file)[0].ravel().tolist() == pixels


def test_codes_by_tile():
    width, height, tiles = 20, 12, [0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 0, 0, 1, 0]
    rng = random.Random(0)
    pixels = [0xFF000000 | rng.randrange(256) << 16 | rng.randrange(8) << 8 | rng.randrange(256) for _ in range(width * height)]

    def body(w):
        w.put(0, 1)
        w.put(0, 1)  # no cache
        w.put(1, 1), w.put(0, 3)  # codes by tiles of four
        w.image([0xFF000000 | t << 8 for t in tiles], 5)
        groups = [[w.code(g + [0] * 272), w.code([8] * 256), w.code([8] * 256), w.code([0] * 255 + [1]), w.code([0] * 40)] for g in ([3] * 8, [1, 2, 3, 4, 5, 6, 7, 7])]
        for i, p in enumerate(pixels):
            own = groups[tiles[i // width // 4 * 5 + i % width // 4]]
            own[0]((p >> 8) & 255), own[1]((p >> 16) & 255), own[2](p & 255)

    assert webp.decode_image(Writer().file(width, height, body))[0].ravel().tolist() == pixels


def sub(a, b):
    return sum((((a >> s) - (b >> s)) & 255) << s for s in (0, 8, 16, 24))


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height, pixels = 6, 5, picture(mode, 6, 5)

    def channels(p):
        return [(p >> s) & 255 for s in (24, 16, 8, 0)]

    def body(w):
        w.put(1, 1), w.put(0, 2), w.put(0, 3)
        w.image([0xFF000000 | mode << 8] * 4, 2)
        w.put(0, 1)
        rest = []
        for i, p in enumerate(pixels):
            y, x = divmod(i, width)
            if i == 0:
                guess = 0xFF000000
            elif y == 0:
                guess = pixels[i - 1]
            elif x == 0:
                guess = pixels[i - width]
            else:
                near = [channels(pixels[k]) for k in (i - 1, i - width, i - width + 1, i - width - 1)]
                guess = sum(c << s for c, s in zip(expected(mode, *near), (24, 16, 8, 0), strict=True))
            rest.append(sub(p, guess))
        w.image(rest, width, True)

    assert webp.decode_image(Writer().file(width, height, body))[0].ravel().tolist() == pixels


def expected(mode, left, top, right, corner):
    """The predictors again, from their definitions."""

    def avg(a, b):
        return [(x + y) // 2 for x, y in zip(a, b, strict=True)]

    def clip(v):
        return min(255, max(0, v))

    plane = [x + t - c for x, t, c in zip(left, top, corner, strict=True)]
    half = [clip(m + (abs(m - c) // 2) * (1 if m > c else -1)) for m, c in zip(avg(left, top), corner, strict=True)]
    select = left if sum(abs(p - x) for p, x in zip(plane, left, strict=True)) < sum(abs(p - t) for p, t in zip(plane, top, strict=True)) else top
    return [
        [255, 0, 0, 0], left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top),
        avg(top, right), avg(avg(left, corner), avg(top, right)), select, [clip(v) for v in plane], half,
    ][mode]


def signed(v):
    return v - 256 if v > 127 else v


def test_cross_colour_and_subtract_green():
    pixels, (to_red, to_blue, red_to_blue) = picture(3, 5, 5), (200, 77, 130)

    def body(w):
        w.put(1, 1), w.put(2, 2)  # subtract green is undone last
        w.put(1, 1), w.put(1, 2), w.put(0, 3)
        w.image([0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red] * 4, 2)
        w.put(0, 1)
        rest = []
        for p in pixels:
            a, g = p >> 24, (p >> 8) & 255
            r, b = ((p >> 16) - g) & 255, (p - g) & 255
            blue = (b - (signed(to_blue) * signed(g) >> 5) - (signed(red_to_blue) * signed(r) >> 5)) & 255
            rest.append(a << 24 | ((r - (signed(to_red) * signed(g) >> 5)) & 255) << 16 | g << 8 | blue)
        w.image(rest, 5, True)

    assert webp.decode_image(Writer().file(5, 5, body))[0].ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [2, 4, 13, 40])
def test_palettes(colours):
    width, height = 11, 6
    pixels = picture(colours, width, height, colours)
    table = sorted(set(pixels))

    def body(w):
        w.put(1, 1), w.put(3, 2), w.put(len(table) - 1, 8)
        w.image([sub(p, q) for p, q in zip(table, [0, *table[:-1]], strict=True)], len(table))
        w.put(0, 1)
        packing = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        per, size, rows = 1 << packing, 8 >> packing, []
        for y in range(height):
            index = [table.index(p) for p in pixels[y * width : (y + 1) * width]]
            rows += [0xFF000000 | sum(v << (k * size) for k, v in enumerate(index[x : x + per])) << 8 for x in range(0, width, per)]
        w.image(rows, -(-width // per), True)

    assert webp.decode_image(Writer().file(width, height, body))[0].ravel().tolist() == pixels


def test_texts_come_back_from_images(spark, odd, empty):
    rng = random.Random(0)
    prose = " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7))) for _ in range(400_000))
    for text in (None, "", "a", "é" * 5000, "".join(map(chr, range(1, 2000))), "x" * 1_000_000, "ab" * 100_000, prose):
        raw = (text or "").encode()
        (image,) = webp.load(webp.store(text))
        back = webp.samples(image).tobytes()
        assert back == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and image.shape[1] == 192
        assert np.array_equal(image.ravel().view(np.uint8).reshape(-1, 4)[:, :3], np.repeat(webp.samples(image), 3).reshape(-1, 3))  # grey
    media = webp.store_media(odd)
    assert webp.decode_media(media).where("size(images) = 1 and images[0].width = 192 and error is null").count() == odd.count()
    assert webp.store_media(empty).count() == 0


def test_long_texts_make_wider_images(monkeypatch):
    monkeypatch.setattr(webp, "MOST", 8)
    for rows in (8, 9, 33):
        text = "".join(chr(48 + i % 70) for i in range(rows * 192))
        (image,) = webp.load(webp.store(text))
        assert len(image) <= 8 and webp.samples(image).tobytes() == text.encode()


def test_each_part_of_the_decoder_runs_for_stored_texts(monkeypatch):
    """Back-references, prefix codes, subtract-green and palettes are what stored texts are read by."""
    seen = {"copies": 0, "literals": 0, "green": 0, "palette": 0}
    place, green, palette = webp._place, webp.undo_subtract_green, webp.undo_palette

    def placing(out, start, symbol, *rest):
        seen["copies"] += int((symbol >= 256).sum())
        seen["literals"] += int((symbol < 256).sum())
        return place(out, start, symbol, *rest)

    def count(name, f):
        def run(*args):
            seen[name] += 1
            return f(*args)

        return run

    monkeypatch.setattr(webp, "_place", placing)
    monkeypatch.setattr(webp, "undo_subtract_green", count("green", green))
    monkeypatch.setattr(webp, "undo_palette", count("palette", palette))
    for text in ("the cat sat on the mat and the cat sat on the hat, all of the day and the night", "0110" * 200):
        webp.load(webp.store(text))
    assert seen["copies"] > 2 and seen["literals"] > 20 and seen["green"] == 2 and seen["palette"] == 1


def test_op6_equals_brute_force(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for r in webp.op6_webp(spark, str(tmp_path)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = webp.store(r["text"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_broken_media_are_told(spark):
    good = webp.store("the text of an image, long enough to be cut")

    def with_data(data):
        chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk

    data = good[20 : 20 + int.from_bytes(good[16:20], "little")]
    bomb = with_data(b"\x2f" + b"\xff" * 3 + b"\x0f" + b"\0" * 40)
    rows = [(1, bytearray(good)), (2, bytearray(good[:40])), (3, None), (4, bytearray(b"RIFFxxxxWEBP")), (5, bytearray(bomb)), (6, bytearray())]
    rows += [(10 + k, bytearray(with_data(data[:k]))) for k in range(5, len(data) - 1)]  # cut inside the chunk
    out = {r["id"]: r for r in webp.decode_media(spark.createDataFrame(rows, "id bigint, media binary")).collect()}
    assert out[1]["error"] is None and len(out[1]["images"][0]["argb"]) == 192
    assert out[2]["error"] and out[4]["error"] and out[3]["images"] is None and out[3]["error"] is None and out[6]["error"] is None
    assert "pixels" in out[5]["error"]
    assert all(out[10 + k]["error"] for k in range(5, len(data) - 1))


def test_crc_of_sharded_texts(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit("é").cast("binary"))).first()[0] == zlib.crc32("é".encode())


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 300])
def test_places_equal_sql(spark, n):
    import duckdb

    docs = spark.createDataFrame([(i * 3, "é" * i) for i in range(n)], "doc_id bigint, text string")
    ours = {r["doc_id"]: (zlib.crc32(r["text"].encode()), r["shard"], r["slot"]) for r in sharding.shard(docs, ["doc_id"]).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT i * 3 AS doc_id, repeat('é', i::INT) AS text FROM range({n}) t(i)")
    assert {r[0]: (r[2], r[4], r[5]) for r in con.execute(sharding.OP7_SQL).fetchall()} == ours


def test_sharding_of_ties_nulls_and_clashing_names(spark):
    rows = [(i % 5 if i % 7 else None, "t", i, f"p{i}", 1) for i in range(60)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _p int, _Place string, _offset int")
    out = sharding.shard(docs, ["doc_id", "text"], 7)
    assert out.columns == [*docs.columns, "row_number", "shard", "slot"]
    found = out.collect()
    assert sorted(tuple(r)[:5] for r in found if r["doc_id"] is not None) == sorted(r for r in rows if r[0] is not None)
    assert sorted(r["row_number"] for r in found) == list(range(120)) and {r["doc_id"] for r in found if r["row_number"] < 18} == {None}
    for k in range(7):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (17, 18)
