import hashlib
import itertools
import zlib

import numpy as np
import pytest

from sievelake.llm import media, url_filter, webp


def images():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:21, 0:33]
    yield (0xFF000000 | (x * 3 & 255) << 16 | (y * 5 & 255) << 8 | (x + y) & 255).astype(np.uint32)
    yield rng.integers(0, 1 << 32, (11, 19)).astype(np.uint32)
    yield rng.choice(np.array([5, 9], np.uint32), (7, 30))
    yield rng.choice(np.array([0xFF112233, 0x80FF0000, 0], np.uint32), (11, 29))
    yield rng.integers(0, 16, (9, 9)).astype(np.uint32) * np.uint32(0x01010101)
    yield rng.integers(0, 200, (13, 20)).astype(np.uint32)
    yield np.full((3, 48), 0x20202020, np.uint32)
    yield np.zeros((1, 1), np.uint32)


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("transforms", [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOR,), (webp.PREDICTOR, webp.CROSS_COLOR, webp.SUBTRACT_GREEN)])
def test_webp_round_trip(transforms, cache_bits):
    every = list(images())
    files = [webp.encode(i, transforms, cache_bits) for i in every]
    for image, (found,) in zip(every, webp.decode(files), strict=True):
        assert np.array_equal(image, found)


def test_webp_palettes():
    for image in itertools.islice(images(), 2, None):
        for transforms in ((webp.COLOR_INDEXING,), (webp.COLOR_INDEXING, webp.PREDICTOR)):
            assert np.array_equal(webp.decode([webp.encode(image, transforms, 4)])[0][0], image)


def test_webp_known_file():
    """One red pixel, written by hand: five codes of one symbol each."""
    bits = webp.Writer()
    for value, n in ((0, 1), (0, 1), (0, 1)):  # no transform, no cache, one group
        bits.put(value, n)
    for symbol in (0, 255, 0, 255, 0):  # green, red, blue, alpha, distance
        bits.put(1, 1)
        bits.put(0, 1)
        bits.put(1 if symbol > 1 else 0, 1)
        bits.put(symbol, 8 if symbol > 1 else 1)
    file = webp.file_of(1, 1, bits.value.to_bytes((bits.size + 7) // 8, "little"))
    assert webp.decode([file])[0][0].tolist() == [[0xFFFF0000]]
    with pytest.raises(ValueError):
        webp.decode([b"RIFF" + file[4:12] + b"VP8 " + file[16:]])


def test_webp_groups_by_entropy_image():
    """Two groups of codes, chosen by block."""
    image = np.zeros((4, 8), np.uint32)
    image[:, 4:] = 0xFF00FF00
    bits = webp.Writer()
    bits.put(0, 1)
    bits.put(0, 1)
    bits.put(1, 1)
    bits.put(0, 3)  # blocks of 4
    webp._append(np.array([[0, 1 << 8]], np.uint32), 2, bits, 0, False)
    for symbols in ((0, 0, 0, 0, 0), (255, 0, 0, 255, 0)):
        for s in symbols:
            bits.put(1, 1)
            bits.put(0, 1)
            bits.put(1 if s > 1 else 0, 1)
            bits.put(s, 8 if s > 1 else 1)
    file = webp.file_of(8, 4, bits.value.to_bytes((bits.size + 7) // 8, "little"))
    assert np.array_equal(webp.decode([file])[0][0], image)


def test_media_round_trip(spark):
    texts = ["", None, "a", "ab" * 500, "line one\nline two " * 40, "é日本" * 77, "x" * (16384 * 192 + 5), "same", "same", "".join(map(chr, range(1, 800)))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int").repartition(2)
    both = [{r["doc_id"]: r for r in df.collect()} for df in (media.round_trip(docs), media.describe(media.to_media(docs)))]
    assert both[0] == both[1]
    for i, text in enumerate(texts):
        raw, r = (text or "").encode(), both[0][i]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert both[0][7]["media_sha256"] == both[0][8]["media_sha256"] and both[0][3]["media_bytes"] < 200
    assert media.round_trip(docs.limit(0)).count() == 0


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def brute(url, rules):
    host, path = url_filter.parse(url)
    good = sorted((r for r in rules if fits(host, path, r)), key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    return (host, path, good[0][0] + good[0][1], good[0][2]) if good else (host, path, None, "allow")


def test_url_rules(spark):
    rng = np.random.default_rng(4)
    labels, paths = ["a", "b", "com", "a-b", "ab", "x"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c"]
    hosts = [".".join(rng.choice(labels, rng.integers(1, 4))) for _ in range(120)]
    rules = list({(h, str(rng.choice(paths))): (h, str(rng.choice(paths)), str(rng.choice(["allow", "block"]))) for h in hosts[:40]}.values())
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://{h}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#/b', 'zz'])}" for h in hosts for _ in range(4)] + ["http://hot.a.com/a/b"] * 500
    urls += [None, "", "a.com/a", "://", "HTTP://A.Com/A?x", "x://a.com", "http://ü.com/ä"]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in url_filter.judge(pages, table).collect())
    want = sorted((str(i if i % 9 else None), h, p, str(r), v) for i, u in enumerate(urls) for h, p, r, v in [brute(u, rules)])
    assert got == want
    assert url_filter.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_hosts_with_control_bytes(spark):
    hosts = [f"{a}com{b}" for a in ("", ".", "x.", "x\x00", "\x01.", "\x02") for b in ("", ".", "\x00x", "\x01x", "\x02x", "\x03", "\x00", "\x01", "\x02")]
    urls = [f"http://{h}/en/a" for h in hosts]
    rules = [("com", "/en/", "block"), ("com\x01x", "/en/", "allow"), ("com\x02x", "/", "block"), ("\x01.com", "/en/a", "allow"), ("com\x00", "", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
