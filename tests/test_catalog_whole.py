"""Catalogue queries on small written tables, against brute force over whole texts."""

import math
import random
import re

import pytest

from tandem.plans import catalog


def tables(spark, folder, **given):
    for name, (rows, kind) in given.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


ISBN = re.compile(r"(?:ISBN[-:]?\s*)?(?:(?:978|979)[- ]?\d{1,5}[- ]?\d{1,7}[- ]?\d{1,6}[- ]?\d|\d{1,5}[- ]?\d{1,7}[- ]?\d{1,6}[- ]?[\dX])", re.I | re.A)
PAGES = re.compile(r"\b(?:p\.?|pp\.?|page|pages)\s+\d+", re.I | re.A)


def brute_book(text):
    year = any(1000 <= int(y) <= 2999 for y in re.findall(r"\d{4}", text, re.A))
    return bool(ISBN.search(text) or "books.google.com" in text.lower() or year and PAGES.search(text))


def test_book_cites_read_whole_texts(spark, tmp_path):
    far, ends = "word " * 400, ["none", "ISBN 9780306406157", "see books.Google.com/x", "of 1999 " + "and " * 300 + "page 12", "page x 12", "in 19"]
    rows = [(20 * i + 2, far * (i % 3) + ends[i % 6]) for i in range(18)] + [(20 * i + 1, far) for i in range(3)] + [(3, None)]
    texts = {}
    for i, t in rows:
        end = {0: " ISBN 9780306406157", 1: " pp. 12-14, (1999", 2: ""}[i % 3]
        texts.setdefault(str(i % 20), []).append(t + end if t is not None else "")
    got = {r.title: (r.n_refs, r.n_books) for r in catalog.queries()["q_book_cites"](spark, tables(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect()}
    assert got == {k: (len(x), sum(map(brute_book, x))) for k, x in texts.items()}
    assert sum(brute_book(t[:400]) for t in texts["2"]) < got["2"][1] < got["2"][0]


def test_section_dedup_compares_whole_texts(spark, tmp_path):
    """The first turn's section goes only if another turn has its whole text; a null text is equal to a null text."""
    talks = {1: ["same start, one end", "same start, other end"], 2: ["the same", "else", "the same"], 3: [None, None], 4: [None, ""], 5: ["alone"], 6: ["x", "y", "y"], 7: ["", ""], 8: ["a" * 5000 + "b", "a" * 5000 + "c"]}
    rows = [(c, k + 1, "user", t) for c, x in talks.items() for k, t in enumerate(x)]
    random.Random(1).shuffle(rows)
    got = {r.conv_id: r["items"] for r in catalog.queries()["q_section_dedup"](spark, tables(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {c: len(x) - (x[0] in x[1:]) for c, x in talks.items()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 1, 6: 3, 7: 1, 8: 2}


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def brute_outline(text):
    lines = [x for x in text.split("\n") if x.strip(" ")]
    levels, tree = [len(x) % 3 + 1 for x in lines], []
    for x in levels:
        tree.append(max(1, min(x, (tree[-1] if tree else 1) + 1)))
    return [x.lower() for x in lines], levels, [x - y for x, y in zip(tree, [0, *tree])]


def brute_compare(a, b):
    (an, al, at), (bn, bl, bt) = brute_outline(a), brute_outline(b)
    ha, hb = ([levels.count(i) for i in (1, 2, 3)] for levels in (al, bl))
    dot, size = sum(x * y for x, y in zip(ha, hb)), math.sqrt(sum(x * x for x in ha) * sum(x * x for x in hb))
    longest, union = max(len(an), len(bn), 1), set(an) | set(bn)
    return {
        "lcs": brute_lcs(an, bn), "lcs_ratio": brute_lcs(an, bn) / longest, "jaccard": len(set(an) & set(bn)) / len(union) if union else 1.0,
        "depth_cosine": dot / size if size else float(not an and not bn), "shape_similarity": brute_lcs(at, bt) / longest,
        "a_outline_length": len(an), "b_outline_length": len(bn), "outline_length_diff": len(bn) - len(an), "outline_length_ratio": len(bn) / len(an) if an else None,
    }


def test_outlines_of_all_lines(spark, tmp_path):
    """Documents of many lines that share their first characters and differ, or agree, further on."""
    rng = random.Random(2)
    line = lambda: f"Chapter {rng.choice('abcdefgh')} of {'many ' * rng.randrange(3)}words"
    texts = ["\n".join(line() if rng.random() < 0.9 else " " for _ in range(n)) for n in (3, 150, 70, 70, 21, 20, 400, 30)] + ["", "one line", "", ""]
    texts += ["\n".join([f"own {k}" for k in range(20)] + tail) for tail in (["end A"] * 9, [f"end {k}" for k in range(30)])]
    at = tables(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    want = {i: brute_compare(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)}
    for name in ("q_outline_jaccard", "q_outline_lcs", "q_depth_cosine", "q_shape_similarity", "q_structure_compare"):
        got = {r.doc_id: r.asDict() for r in catalog.queries()[name](spark, at).collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            del r["doc_id"]
            assert r == {k: pytest.approx(want[i][k], abs=1e-6) if want[i][k] is not None else None for k in r}, (name, i)
    assert want[2]["a_outline_length"] > 20


def test_html_parse_reads_whole_pages(spark, tmp_path):
    """Pages of known contents, long, broken off and without their optional tags: counts of what was put in."""
    rng = random.Random(3)
    rows, want = [], {}

    def add(refs, heads, paragraphs, end="</article></body></html>", wrap="<html><head><title>T</title><script>var t='</p><p>x';</script></head><body>", ends=True):
        i, body, parts = len(rows), "", ["h"] * (heads - 1) + ["p"] * paragraphs
        rng.shuffle(parts)
        for k, kind in enumerate(["h", *parts] if heads else parts):
            tag = f"h{1 + (k > 0) * rng.randrange(1, 3)}"
            close = "</p>" if ends or rng.random() < 0.5 else ""
            body += f"<{tag} class=c>Head {k} of {i}</{tag}>" if kind == "h" else f"<P class=\'x\'>Text <b>{k}</b> of {i} &amp; more{close}\\n"
        nav = "<nav class=n><ul>" + "".join(f"<li><a href=/{k}>Menu {k}</a></li>" for k in range(refs)) + "</ul></nav>"
        rows.append((i, f"u{i}", f"{wrap}{nav}<article>{body}{end}"))
        want[f"u{i}"] = (f"Head 0 of {i}" if heads else None, heads, paragraphs, refs)

    add(2, 1, 3)
    add(9, 40, 1500)
    add(0, 3, 7, ends=False)
    add(4, 2, 5, end="", ends=False)
    add(1, 1, 2, wrap="")
    add(3, 0, 0)
    add(1, 0, 4, end="<p>Text <b>0</b> of 6 &amp; more</p></article>")
    rows += [(20, "null", None), (21, "empty", "")]
    want |= {"null": (None, 0, 0, 0), "empty": (None, 0, 0, 0)}
    at = tables(spark, tmp_path, pages=(rows, "page_id long, url string, html string"))
    assert {r.url: (r.main_title, r.sections, r.paragraphs, r.refs) for r in catalog.queries()["q_html_parse"](spark, at).collect()} == want
