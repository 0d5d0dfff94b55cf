"""WARC, HTML, fingerprints, quality, mixing and the pipeline."""

import hashlib
import io
import math
import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import fingerprint, html_text, line_dedup, mixing, near_dedup, quality, queries, warc
from tandem.llm.common import scratch, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- WARC


def archive():
    records = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 40) for i in range(12)]
    return records, [warc.member(r) for r in records]


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(zipped):
    parts = archive()[zipped]
    data, rng = b"".join(parts), random.Random(zipped)
    assert [x.fields["x-page-id"] for x in warc.salvage(io.BytesIO(data))] == [str(i) for i in range(12)]
    for _ in range(60):
        hurt = bytearray(data)
        hurt[rng.randrange(len(hurt))] ^= 1 << rng.randrange(8)
        found = list(warc.salvage(io.BytesIO(bytes(hurt))))
        assert sum(isinstance(x, warc.Record) for x in found) >= 11
        cut = rng.randrange(len(data))
        found = list(warc.salvage(io.BytesIO(data[:cut])))
        whole = [sum(map(len, parts[: k + 1])) for k in range(12)]
        assert sum(isinstance(x, warc.Record) for x in found) == sum(w <= cut for w in whole)
        junk = bytes(rng.randrange(1, 256) for _ in range(500))
        found = list(warc.salvage(io.BytesIO(data[: len(parts[0])] + junk + data[len(parts[0]) :])))
        gaps = [x for x in found if isinstance(x, warc.Gap)]
        assert len(found) - len(gaps) == 12 and sum(g.end - g.start for g in gaps) <= 500
    assert list(warc.salvage(io.BytesIO(b"nothing here"))) == [warc.Gap(0, 12, "no record")]
    assert list(warc.salvage(io.BytesIO(b""))) == []


def test_long_record_and_false_version_lines():
    body = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" * 5000
    found = list(warc.salvage(io.BytesIO(warc.record(1, "u", body) + warc.record(2, "v\r\nbad", b""))))
    assert [x.fields["x-page-id"] for x in found] == ["1", "2"] and found[0].payload == body


def test_salvage_inside_a_member():
    """One member of many records: those before and after a bad one stay, and those before a byte at which inflation fails or ends."""
    rng = random.Random(5)
    records = [warc.record(i, f"http://x/{i}", rng.randbytes(2000)) for i in range(12)]
    ids = lambda found: [int(x.fields["x-page-id"]) for x in found if isinstance(x, warc.Record)]
    gaps = lambda found: [(x.start, x.end) for x in found if isinstance(x, warc.Gap)]
    read = lambda data: list(warc.salvage(io.BytesIO(data)))
    bad = bytearray(records[5])
    bad[-100] ^= 1
    whole, after = warc.member(b"".join([*records[:5], bytes(bad), *records[6:]])), warc.member(warc.record(12, "u", b"after"))
    for junk in (b"", b"junk"):
        found = read(junk + whole + after)
        assert ids(found) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12] and gaps(found)[-1] == (len(junk), len(junk + whole)) and len(gaps(found)) == 1 + bool(junk)
    assert ids(read(whole)) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    one = warc.member(b"".join(records))
    assert ids(read(one)) == list(range(12)) and not gaps(read(one))
    hurt = bytearray(one)
    hurt[len(one) // 2] ^= 255
    found = read(bytes(hurt) + after)
    assert set(ids(found)) >= {0, 1, 2, 3, 4, 12} and gaps(found) == [(0, len(one))] and all(warc.record(int(x.fields["x-page-id"]), x.fields["warc-target-uri"], x.payload) in [*records, warc.record(12, "u", b"after")] for x in found if isinstance(x, warc.Record))
    found = read(one[: len(one) // 2])
    assert ids(found) == [0, 1, 2, 3, 4] and gaps(found) == [(0, len(one) // 2)]


def test_damage_never_raises():
    """10,000 archives with headers and other bytes changed, cut out, put in or doubled: records that come are those that were written, gaps cover the rest."""
    records = [warc.record(i, f"http://x/{i}", b"<p>%d</p>" % i * 20, 0 if i == 3 else None) for i in range(5)]
    known, rng = {r for r in records}, random.Random(31)
    heads = [b"Content-Length: \xc2\xb2", b"Content-Length: " + b"9" * 5000, b"Content-Length: 999999999999", b"X-Page-ID: " + b"8" * 30, b"\r\n\r\n", b"Content-Length: -1", b"WARC/1.1\r\n", b"\xff\xfe", b":", b"\0", warc.MEMBER]
    for n in range(10_000):
        zipped = n % 2
        data = bytearray(b"".join(map(warc.member, records) if zipped and n % 4 == 1 else records))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data))
            kind = rng.randrange(5)
            if kind == 0:
                data[at] = rng.randrange(256)
            elif kind == 1:
                del data[at : at + rng.randrange(1, 40)]
            elif kind == 2:
                data[at:at] = rng.choice(heads)
            elif kind == 3:
                line = data.find(b"\r\n", at)
                if line < 0 or data.find(b"\r\n", line + 2) < 0:
                    continue
                data[line + 2 : data.find(b"\r\n", line + 2)] = rng.choice(heads)
            else:
                data[at:at] = data[at : at + rng.randrange(300)]
        if zipped and n % 4 == 3:
            data = bytearray(warc.member(bytes(data)))
        for x in warc.salvage(io.BytesIO(bytes(data)), most=1 << 20):
            if isinstance(x, warc.Record) and "x-page-id" in x.fields:
                number = lambda k: int(x.fields[k]) if k in x.fields else None
                payload = x.payload if x.fields["warc-type"] == "response" else b"<p>3</p>" * 20
                assert warc.record(number("x-page-id"), x.fields["warc-target-uri"], payload, number("x-refers-to-page-id")) in known
            elif isinstance(x, warc.Gap):
                assert 0 <= x.start < x.end <= len(data)


def test_salvage_in_bounded_memory():
    """A wrong length, a member that inflates to more than the bound, and records before and after them."""
    small = [warc.record(i, "u", b"x" * 200) for i in range(4)]
    false = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999999\r\n\r\nxx"
    bomb = warc.member(small[1] + warc.record(9, "u", b"\0" * (8 << 20)))
    found = list(warc.salvage(io.BytesIO(small[0] + false + bomb + small[2] + warc.member(small[3])), most=1 << 20))
    assert [x.fields["x-page-id"] for x in found if isinstance(x, warc.Record)] == ["0", "1", "2", "3"]
    assert "too long" in {x.reason for x in found if isinstance(x, warc.Gap)}


def test_round_trip_of_odd_pages(spark):
    same = "s" * 150
    rows = [(3, "u", same), (1, "u", same), (2, None, same), (None, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (1, "u", same), (8, "ü", "é" * 99), (9, "u", "x" * 500_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted(map(tuple, warc.warc_round_trip(spark, pages).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), digest(t), "revisit" if t == same and i in (2, 3) else "response", 1 if t == same and i in (2, 3) else None) for i, _, t in rows]
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_reader_gives_payloads_and_gaps(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(30)], "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    written = warc.write_archives(pages.coalesce(1), folder)
    assert sum(r.records for r in written.collect()) == 30
    path = written.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(40)
        f.write(b"\0" * 10)
    out = warc.read_archives(written).collect()
    assert sum(r.kind == "gap" for r in out) == 1 and sum(r.kind == "record" for r in out) == 29
    assert all(r.payload.decode().startswith("page") for r in out if r.kind == "record")


# -- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>{before}<article><h1>Head &amp; line</h1><p><b>First
 par<br>agraph<p>Second &lt;here&gt;</p></article><div class="comments">reader says</div>{after}</body></html>"""


def test_main_text_rules():
    nav = '<nav><ul><li><a href="/x">Menu</a></ul></nav><header>Top</header><aside>Side</aside><div class="ad">Buy</div><form>F</form>'
    assert html_text.main_text(PAGE.format_map({"before": nav, "after": "<footer>&copy;</footer>"}) if False else PAGE.replace("{before}", nav).replace("{after}", "<footer>&copy;</footer>")) == "Head & line First par agraph Second <here>"
    assert html_text.main_text("<div><p>a<p>b<div id=cookie-notice>c</div><table><tr><td>1<td>2</table><!-- x --></div>") == "a b 1 2"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>&nbsp;</p>") == ""
    assert html_text.main_text("x < y</b></div> z") == "x < y z"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_repeated_branches_go_without_marks(spark):
    page = lambda i: f"<body><div><span>Same slogan everywhere</span></div><section><p>Own text {i} of page {i}</p></section><div><em>Again the same</em></div></body>"
    rows = [(i, "http://h/a", page(i)) for i in range(40)] + [(100, "http://lone/a", page(1)), (101, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert all("slogan" not in got[i] and "Again" not in got[i] and f"page {i}" in got[i] for i in range(40))
    assert "slogan" in got[100] and got[101] == "" and len(got) == 42


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://h/a", "<article><p>The same article on every page</p></article>") for i in range(30)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same article on every page"}


def test_repeated_boxes_inside_an_article_go(spark):
    """Importance decides inside article and main; copies of an article, also with other adverts around, are one page."""
    notice = "<div><span>Buy our plan today</span></div>"
    rows = [(i, "http://h/a", f"<{tag}><section><p>Own text {i} here</p></section>{notice}</{tag}>") for i, tag in enumerate(["article"] * 20 + ["main"] * 20)]
    rows += [(100 + i, "http://copies/a", f"<div>Advert {i}</div><article><p>One article</p>{notice}</article>") for i in range(30)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == {i: f"Own text {i} here" if i < 40 else "One article Buy our plan today" for i in got} and len(got) == 70


def test_repeated_lists_of_many_items_go(spark):
    """Items of one node are one content of their page; inner nodes have their branches' importance."""
    items = "".join(f"<li><em>Link {k}</em></li>" for k in range(6))
    page = lambda i: f"<body><div><h4>Links</h4><ul>{items}</ul></div><div class=x><p>One line<p>Two lines</div><section>Lead in<p>Own {i}<p>text {i}</section></body>"
    rows = [(i, "http://h/a", page(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == {i: f"Own {i} text {i}" for i in range(40)}
    found = html_text.tree_importance([r.asDict() for r in html_text.nodes(pages).collect()])
    keys = {(n.tag, n.parent.tag): n.key for n in html_text.parse(page(0)).nodes if n.parent}
    assert found[keys["ul", "div"]][0] == found[keys["div", "body"]][0] == 0 and found[keys["section", "body"]][0] > 0.4 and found[keys["body", ""]][1] == 1


def test_a_rare_part_of_a_low_branch_stays(spark):
    rows = [(i, "http://h/a", f"<div><h4>Notice</h4><p>The same</p>{'<q2>Once only ' + str(i) + '</q2>' if i < 3 else ''}</div><section>Own {i}</section>") for i in range(40)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: (f"Once only {i} " if i < 3 else "") + f"Own {i}" for i in range(40)}


def brute_low(pages):
    """host -> (low branches, nodes of low own content), by plain loops over parsed pages, with chains of labels as nodes."""
    by_host = {}
    for url, page in pages:
        name = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
        parsed = html_text.parse(page)
        digest = tuple((n.key, t) for n, t in html_text.read_blocks(parsed))
        seen = {}
        for node, text in parsed.blocks:
            seen.setdefault(node.key, {"up": node.parent and node.parent.key, "shapes": set(), "texts": [], "article": node.article})["texts"].append(text)
            while node is not None:
                seen.setdefault(node.key, {"up": node.parent and node.parent.key, "shapes": set(), "texts": [], "article": node.article})["shapes"].add(tuple(dict.fromkeys(node.children)))
                node = node.parent
        by_host.setdefault(name[1].lower() if name else "", {}).setdefault(digest, seen)
    out = {}
    for host, distinct in by_host.items():
        nodes = {}
        for seen in distinct.values():
            for k, x in seen.items():
                n = nodes.setdefault(k, {"up": x["up"], "article": x["article"], "pages": 0, "s": [], "c": []})
                n["pages"] += 1
                n["s"] += [tuple(sorted(x["shapes"]))] if any(x["shapes"]) else []
                n["c"] += [tuple(x["texts"])] if x["texts"] else []

        def entropy(items):
            if len(items) < html_text.MIN_PAGES:
                return 1.0
            return -sum(items.count(v) / len(items) * math.log(items.count(v) / len(items)) for v in set(items)) / math.log(len(items))

        def rate(k):
            n = nodes[k]
            parts = [(nodes[c]["pages"], *(rate(c) if nodes[c]["pages"] >= html_text.MIN_PAGES else (1.0, 1.0))) for c in nodes if nodes[c]["up"] == k and c != k]
            inner = bool(parts)
            parts += [(len(n["c"]), entropy(n["c"]), entropy(n["c"]))] if n["c"] else []
            mean = sum(w * x for w, x, _ in parts) / sum(w for w, _, _ in parts)
            value = (1 - html_text.DECAY) * (entropy(n["s"]) if n["s"] else 0.0) + html_text.DECAY * mean if inner else mean
            return value, max(m for _, _, m in parts)

        often = [k for k in nodes if nodes[k]["pages"] >= html_text.MIN_PAGES]
        limit = {k: html_text.LOW_IN_ARTICLE if nodes[k]["article"] else html_text.LOW for k in often}
        branches = {k for k in often if rate(k)[0] < limit[k] and rate(k)[1] < html_text.CARRIES}
        out[host] = branches, {k for k in often if nodes[k]["c"] and entropy(nodes[k]["c"]) < limit[k] and k not in branches}
    return out


def brute_text(page, branches, contents):
    parsed, out = html_text.parse(page), []
    for node, text in html_text.read_blocks(parsed):
        up, dropped = node, node.key in contents
        while up is not None:
            dropped, up = dropped or up.key in branches, up.parent
        out += [] if dropped else [text]
    return " ".join(out)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for i in range(150):
        kind, host = i % 3, f"h{i % 4}"
        links = "".join(f"<li><a>Link {k} {i % 5 if kind else 0}</a>" for k in range(rng.randrange(2, 5)))
        own = "".join(f"<p>{word()} <b>{word()}</b> {i if rng.random() < 0.8 else 'same'}</p>" for _ in range(rng.randrange(1, 4)))
        box = f"<section class=x><h4>Offer {i % 2}</h4><p>Buy now</p>{'<q>rare ' + str(i) + '</q>' if i % 40 == 0 else ''}</section>"
        body = [f"<div><ul>{links}</ul></div><main>{own}{box}</main>", f"<div>{own}</div>{box}<div class=menu>{links}</div>", f"<ul>{links}</ul><td>{own}"][kind]
        rows.append((i, f"http://{host}/{i}", f"<body>{body}<div>End of {host}</div></body>"))
    rows += [(200 + i, f"http://h0/{i}", rows[0][2]) for i in range(20)] + [(300, None, None), (301, None, "<p>x"), (302, "http://h1/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op7_html_text(spark, str(tmp_path)).collect()}
    low = brute_low([(u, h) for _, u, h in rows])
    want = {i: brute_text(h, *low[re.match("http://([^/]*)", u)[1] if u else ""]) for i, u, h in rows}
    assert got == {i: (u, want[i], len(want[i])) for i, u, _ in rows}
    assert sum(brute_text(h, set(), set()) != want[i] for i, _, h in rows) > 60


def test_deep_and_broken_pages_in_linear_time():
    import time

    began = time.perf_counter()
    assert html_text.main_text("<div>" * 100_000 + "deep", frozenset([5])) == "deep"
    assert len(html_text.main_text("<div>x" * 30_000)) == 59_999
    assert html_text.main_text('<a "' * 50_000 + "z").startswith('<a "')
    assert html_text.main_text("<p " + "<b '" * 20_001 + ">end").endswith("end")
    assert html_text.main_text("</b>" * 1000 + "<i>" * 50_000 + "</b>" * 50_000 + "y") == "y"
    assert html_text.main_text('<p>a<img alt="x>b<p>c') == "a b c"
    assert time.perf_counter() - began < 20


HOT = "/root/testdata/check_s/pages.parquet"


@pytest.mark.skipif(not __import__("os").path.exists(HOT), reason="needs the tables of the check")
def test_the_tree_alone_on_a_large_host(spark):
    """Without marks or <article> as priors, the learnt tree gives the same text on a host of many pages; without the tree, menus and footers stay."""
    pages = spark.read.parquet(HOT)
    host = pages.groupBy(html_text.host(F.col("url")).alias("h")).count().orderBy(F.desc("count")).first().h
    pages = pages.where(html_text.host(F.col("url")) == host)
    low = frozenset(html_text.low_nodes(pages).first().low)
    for r in pages.collect():
        assert html_text.main_text(r.html, low, prior=False) == html_text.main_text(r.html) != html_text.main_text(r.html, prior=False)


# -- fingerprints


def test_prefix_hash():
    rng = random.Random(6)
    for _ in range(60):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(80)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("ab") for _ in range(20))
        x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert x.extension(i, y, j) == want
        n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])


def big_fingerprint(text):
    """The fingerprint with plain big integers: no prefix arrays, no inverse powers."""
    p, mask = 2**31 - 1, 2**64 - 1
    hashed = lambda t: tuple(sum((ord(c) + 1) * pow(b, j, p) for j, c in enumerate(t)) % p for b in fingerprint.BASES)
    least = {}
    size = min(12, len(text))
    for i in range(len(text) - size + 1 if text else 0):
        one, two = hashed(text[i : i + size])
        x = one << 31 | two
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        x ^= x >> 31
        least[x >> 58] = min(least.get(x >> 58, mask), x)
    one, two = hashed(text)
    return f"{one << 31 | two:016x}:" + "".join(f"{(least[k] * 0x9E3779B97F4A7C15 >> 40) & 0xFFF:03x}" if k in least else "---" for k in range(64))


def big_likeness(a, b):
    if a == b:
        return 1.0
    slots = [(a[i : i + 3], b[i : i + 3]) for i in range(17, 17 + 3 * 64, 3)]
    used = [x for x in slots if x != ("---", "---")]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def brute_fingerprints(rows):
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) ^ 1 << 63, t)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1] or "")))
    texts = [t or "" for _, t in ordered]
    known = {}
    own = lambda t: known.setdefault(t, None) or known.__setitem__(t, big_fingerprint(t) if len(t) < 2000 else fingerprint.fingerprint(fingerprint.PrefixHash(t))) or known[t]
    prints = [own(t) for t in texts]
    out = []
    for k, (i, _) in enumerate(ordered):
        n = (k + 1) % len(ordered)
        cut = len(texts[k]) // 3
        edited = texts[k][: len(texts[k]) - cut] + texts[n][:cut]
        new = own(edited)
        out.append((i, len(texts[k]), hashlib.sha256(edited.encode()).hexdigest(), prints[k], new, big_likeness(prints[k], new), big_likeness(prints[k], prints[n])))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints(odd_documents, no_documents, parts):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = [tuple(r)[:7] for r in fingerprint.fingerprints(odd_documents.repartition(parts)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(brute_fingerprints(rows), key=key)
    assert fingerprint.fingerprints(no_documents).count() == 0
    assert fingerprint.fingerprints(odd_documents.where("doc_id = 3")).first().near_next == 1.0


@pytest.mark.parametrize("ranges", [1, 3, 60])
def test_fingerprints_across_ranges(spark, odd_documents, ranges, monkeypatch):
    """Borders of ranges: an id and a key that many rows share, null ids, the ends of a long. Nothing is written on the way."""
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if len(r.text or "") < 2000]
    rows += [(50, f"text {k % 40} of one id") for k in range(120)] + [(None, f"no id {k}") for k in range(30)] + [(-(2**63), "least"), (2**63 - 1, "most"), (0, "zero"), (-1, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(fingerprint, "ROWS", 1, raising=False)
    files = lambda: set(Path(shared_dir(spark).removeprefix("file://")).glob("fingerprints*"))
    before, partitions = files(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        got = [tuple(r)[:7] for r in fingerprint.fingerprints(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(brute_fingerprints(rows), key=key)
    assert files() == before


def test_a_range_without_its_border_raises():
    batch = lambda *borders: pa.RecordBatch.from_pylist([{"part": 0, "border": b, "doc_id": k, "text": "a text"} for k, b in enumerate(borders)])
    assert sum(b.num_rows for b in fingerprint._walk(iter([batch(False, False), batch(True, True)]))) == 2
    with pytest.raises(ValueError):
        list(fingerprint._walk(iter([batch(False, False)])))


def test_likeness():
    f = lambda t: fingerprint.fingerprint(fingerprint.PrefixHash(t))
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    b = a[:2000] + "".join(rng.choice("abcdefghij ") for _ in range(1000))
    assert fingerprint.likeness(f(a), f(a)) == fingerprint.likeness(f(""), f("")) == 1 and fingerprint.likeness(f(a), f("")) == 0
    assert 0.3 < fingerprint.likeness(f(a), f(b)) < 0.7 and fingerprint.likeness(f(a), f(a[::-1])) < 0.1


# -- quality


def brute_features(text):
    t = text or ""
    words = WORD.findall(t)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered))


def test_quality_features(spark, odd_documents):
    rng = random.Random(7)
    texts = [r.text for r in odd_documents.collect()] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + "\n#x\n \n#x" for _ in range(80)] + ["a b c d e f g h " * 3, "a " * 8, "a " * 9, "a " * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in quality.FEATURES) for r in quality.features(df).collect()}
    assert got == {i: brute_features(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 30, 400, 5000) for k in range(0, min(n, 120), 7)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p"))
    for r in df.collect():
        want = sum(math.comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1)) if r.k < r.n * 0.02 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_thresholds_control_rejection(spark, odd_documents, no_documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        docs.append((i, " ".join(word() + ("##$" if bad else "") for _ in range(25)), "en" if i % 2 else None))
        labels.append((i, int(not bad)))
    docs.append((9999, "zz zz", "en"))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(d, lab).collect()}
    assert all(got[i].kept == bool(y) for i, y in labels) and got[9999].base_failed and not got[9999].kept
    few = quality.quality_rules(d, lab.where("doc_id < 60")).collect()
    assert all(r.kept != r.base_failed for r in few)  # too few labels to certify any cutoff
    kept = quality.filter_documents(odd_documents, lab)
    assert kept.columns == odd_documents.columns and kept.where("size IS NULL").count() == 0
    assert quality.quality_rules(no_documents, lab).count() == 0 and quality.quality_rules(odd_documents, lab.limit(0)).count() == odd_documents.count()


def test_the_verdict_rejects_few_good_documents(spark):
    """Over many strata drawn at random, the verdict of all rules together rejects more than alpha of the good documents in no more than about delta of them."""
    rng, alpha = random.Random(21), 0.05
    rows, labels = [], []
    for i in range(60 * 400):
        good = rng.random() < 0.8
        level = lambda worse: max(0, int(rng.gauss(8, 5) + (0 if good else worse)))
        rows.append((i, f"l{i % 60}", 100, 500 + level(900), level(60), min(25, level(12) // 8), min(25, level(15))))
        labels += [(i, int(good))] * (1 + (i % 9 == 0))
    scored = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.FEATURES))
    cutoffs = quality.thresholds(scored, spark.createDataFrame(labels, "doc_id long, quality int"), alpha=alpha)
    # Fresh documents of the same kind stand for the whole of a stratum.
    fresh = []
    for i in range(60 * 1000):
        level = lambda: max(0, int(rng.gauss(8, 5)))
        fresh.append((i, f"l{i % 60}", 100, 500 + level(), level(), min(25, level() // 8), min(25, level())))
    out = quality.judge(spark.createDataFrame(fresh, scored.schema), cutoffs).where("NOT base_failed").groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("rate")).collect()
    over = sum(r.rate > alpha + 3 * (alpha / 1000) ** 0.5 for r in out)
    assert cutoffs.count() > 30 and over <= 3


def test_quality_columns_of_clashing_names(spark):
    clash = ["_w", "_l", "_h", "_p", "_e", "_s", "_stratum", "_c0", "_d0", "n_words", "kept", "base_failed", "a.b"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", *map(str, range(len(clash)))) for i in range(5)] + [(9, None, None, *[None] * len(clash))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in clash))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    out = quality.filter_documents(docs, labels)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[:5]
    assert quality.quality_rules(docs, labels).count() == 6 and quality.features(docs).columns[-5:] == quality.FEATURES


# -- mixing


def test_mixing(spark, odd_documents, no_documents):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(3000)] + [(5000, None, "a"), (5001, "x", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(i)
    total = sum(size.values())
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    own = {s: sum(size[i] for i in by[s]) for s in by}
    target, open_ = {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * own[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * own[s] for s in over}
        open_ -= over
    for s, ids in by.items():
        assert all(got[i].target == pytest.approx(target[s]) and got[i].source_size == own[s] and got[i].size == size[i] for i in ids)
        assert all(got[i].taken % max(size[i], 1) == 0 and got[i].taken <= 3 * size[i] for i in ids)
        assert abs(sum(got[i].taken for i in ids) - target[s]) <= 200
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(9)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] * size[r.doc_id] for r in mixed} == {i: t for i, t in again.items() if t}
    assert mixing.mix(odd_documents).count() == odd_documents.count() and mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    assert mixing.mix(no_documents).count() == 0 and mixing.mix(docs.where("text IS NULL")).first().taken == 0


def test_inclusion_frequencies(spark, monkeypatch):
    """Over many seeds, how often a document of the query is taken follows its inclusion probability, and the words taken stay at the target."""
    rows = [(i, "w " * (3 if i % 3 else 40), "a") for i in range(300)] + [(1000 + i, "w " * 20, "b") for i in range(300)] + [(None, "w " * 20, "b"), (None, "v " * 20, "b"), (7, "x " * 40, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    seen, n = {}, 12
    for seed in range(n):
        monkeypatch.setattr(mixing, "SEED", f"seed{seed}")
        got = mixing.mix(docs).collect()
        for r in got:
            if r.doc_id is not None and r.doc_id < 1000:
                seen.setdefault(r.size, []).append(r.taken // r.size)
        target = next(r.target for r in got if r.size == 3)
        assert abs(sum(r.taken for r in got if r.doc_id is not None and r.doc_id < 1000) - target) <= 40
    own = {s: len(x) // n for s, x in seen.items()}
    total = sum(s * k for s, k in own.items())
    rate = target / total
    mean = sum(len(bin(s)[2:]) * s * k for s, k in own.items()) / total
    due = {s: int(rate) + (rate - int(rate)) * len(bin(s)[2:]) / mean for s in own}
    for s, x in seen.items():
        assert sum(x) / len(x) == pytest.approx(due[s], abs=0.06)
    assert due[40] > due[3] + 0.2


# -- pipeline


@pytest.mark.skipif(not __import__("os").path.exists(queries.PIECE_MODEL), reason="needs the vocabulary file")
def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(160):
        body = " ".join(word() for _ in range(40))
        rows.append((i, f"{body}\nall rights are reserved here\n{word()} {word()}", "en", f"s{i % 7}"))
    rows += [(200 + i, rows[i][1] + " x", "en", f"s{i % 7}") for i in range(20)] + [(300, "too short", "en", "s1"), (301, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "sentencepiece"]
    left = [r for r in rows if brute_features(r[1])[0] >= 20 and 100 * brute_features(r[1])[4] <= 30 * brute_features(r[1])[0]]
    from tests.llm.test_dedup import brute_components, brute_lines

    texts = dict(brute_lines([(i, t, s) for i, t, _, s in left], 5, 3))
    heads = brute_components(list(texts.items()))
    stay = [r for r in left if heads[r[0]] == r[0]]
    cleaned = spark.createDataFrame([(r[0], texts[r[0]], r[3]) for r in stay], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(cleaned).collect()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.round_trip
    assert got == {i: n for i, n in taken.items() if n} and len(out) > 100
    stage = line_dedup.remove_lines(docs)
    assert stage.columns == docs.columns and near_dedup.deduplicate(docs).columns == docs.columns


CLASH = ["_c0", "_d0", "_gone", "_stratum", "clean", "removed", "lines", "size", "key", "kept", "n_words", "a.b"]


@pytest.mark.skipif(not __import__("os").path.exists(queries.PIECE_MODEL), reason="needs the vocabulary file")
def test_pipeline_of_odd_rows(spark, tmp_path):
    """A certified rule, null and repeated ids, nulls in every column, extra columns of clashing names: each stage keeps the columns, and rejects what it should."""
    rng = random.Random(27)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("##$" if i % 4 == 0 else "") for _ in range(25)), "en", f"s{i % 6}") for i in range(3000)]
    rows += [(None, " ".join(word() for _ in range(30)), "en", None), (None, " ".join(word() for _ in range(30)), None, "s1"), rows[1], (2, rows[1][1], "en", "s1"), (4000, None, None, None), (4001, " \n", "en", "s1"), (4002, "w " * 19, "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *["x"] * len(CLASH)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(2400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.schema == docs.schema, name
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        if k == 0:  # all bad documents are told by their symbols, and those that weren't labelled too
            assert {i for i in ids if i is not None} == {i for i in range(3000) if i % 4} and ids.count(None) == 2 and ids.count(1) == 2
        if k == 2:  # document 2 has, besides its own text, that of document 1: the two are one group, of which all rows of the smallest id stay
            assert 2 not in ids and ids.count(1) == 2 and ids.count(None) == 2
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert out.count() == now.count() and out.where("NOT round_trip").count() == 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty if name != "sentencepiece" else empty.select("doc_id", "text"), str(tmp_path))
        assert empty.count() == 0, name


def test_queries_are_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= names
