"""Template leaks, page text and archive audits on hand-made cases."""

import os
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lexiframe.llm import templates as tp
from lexiframe.llm import warc_audit as wa
from lexiframe.llm.html_text import extract_text, main_text
from tests.llm.helpers import clashing, documents, text, words

QUESTION = ("Alice has 12 apples and gives 5 km of rope to Bob before noon, so how many apples does Alice still hold "
            "when the long market day has ended and everyone walked home?")


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _leaks(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in tp.leaks(clashing(documents(spark, docs)), _items(spark, items)).collect()}


ITEMS = [(1, QUESTION), (2, text(50, 30)), (3, "just four short words"), (4, None), (5, text(51, 6)), (6, text(50, 30))]


def _twin(docs, items):
    """The rules on plain tuples of tokens: every pair of windows is compared."""
    def clean(t):
        return regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t or "")).strip()

    def template(c):
        c = regex.sub(r"(?<![\p{L}\p{N}])[0-9][\p{L}\p{N}]*", "#n", c)
        c = regex.sub(rf"(?<=#n )(?i:{'|'.join(tp.UNITS)})(?![\p{{L}}\p{{N}}])", "#u", c)
        return regex.sub(r"(?<![\p{L}\p{N}#])\p{Lu}\p{Ll}[\p{L}\p{N}]*", "#p", c).lower().split()

    out = {}
    for item, was in set(items):
        t, r = template(clean(was)), clean(was).lower().split()
        k = min(len(t), tp.WINDOW)
        if not k:
            continue
        few = {i: sum(x[0] != "#" for x in t[i:i + k]) < tp.MIN_LITERALS for i in range(len(t) - k + 1)}
        for doc, now in set(docs):
            dt, dr = template(clean(now)), clean(now).lower().split()
            if k < tp.WHOLE and len(dt) != k:
                continue
            pairs = [(i, j) for i in few for j in range(len(dt) - k + 1)]
            typed = [(i, j) for i, j in pairs if not few[i] and t[i:i + k] == dt[j:j + k]]
            own = {(i, j) for i, j in pairs if r[i:i + k] == dr[j:j + k]}
            good = {(i, j, False) for i, j in own if few[i]}
            for shift in {j - i for i, j in typed}:
                at = [i for i, j in typed if j - i == shift]
                votes = Counter((r[i + x], dr[i + shift + x]) for i in at for x in range(k) if t[i + x][0] == "#")
                best = {w: min((-n, v) for (w2, v), n in votes.items() if w2 == w)[1] for w, _ in votes}
                good |= {(i, i + shift, r[i:i + k] != dr[i + shift:i + shift + k]) for i in at
                         if all(best[r[i + x]] == dr[i + shift + x] for x in range(k) if t[i + x][0] == "#")}
            row = k == tp.WINDOW and any(all((i + x, j + x) in own for x in range(tp.RUN - tp.WINDOW + 1)) for i, j in own)
            met, of, typed_met = {i for i, _, _ in good}, [i for i in few if not few[i]], {i for i, _, _ in good if not few[i]}
            if len(met) >= tp.MIN_COVERAGE * len(few) or (typed_met and len(typed_met) >= tp.MIN_COVERAGE * len(of)) or row:
                out[doc, item] = (len(few), len(met), any(c for *_, c in good))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaks_against_a_twin(spark, monkeypatch, limit):
    monkeypatch.setattr(tp, "BROADCAST_HASHES", limit)
    rnd = random.Random(8)
    pool = "Anna Bob 3 4 7 km days apples the of gives and Tom market ends 12 then rope Paris".split()
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([1, 2, 4, 6, 7, 8, 9, 20, 40])))) for i in range(25)]
    docs = []
    for i in range(150):
        w = rnd.choice(items)[1].split()
        lo = rnd.randrange(len(w))
        w = [rnd.choice(pool) if rnd.random() < rnd.choice([0, 0.1]) else x for x in w[lo // 2:]]
        docs.append((i, ", ".join([*[rnd.choice(pool) for _ in range(rnd.randrange(6))], *w, *[rnd.choice(pool) for _ in range(rnd.randrange(6))]])))
    got = {k: (r.item_windows, r.windows_met, r.reparameterised) for k, r in _leaks(spark, docs, items).items()}
    want = _twin(docs, items)
    assert got == want and len(want) > 20 and any(w[2] for w in want.values())


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, tmp_dir):
    """A copy and a clean text under one id, and under none: only the copies go."""
    _items(spark, ITEMS).write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = documents(spark, [(7, QUESTION), (7, text(3, 50)), (None, QUESTION), (None, text(5, 50)), (8, text(6, 30)), (8, text(6, 30))])
    left = tp.decontaminated(spark, docs, tmp_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(7, text(3, 50)), (None, text(5, 50)), (8, text(6, 30)), (8, text(6, 30))], key=str)
    found = tp.leaks(docs, _items(spark, [ITEMS[0]])).collect()
    assert sorted(str(r.doc_id) for r in found) == ["7", "None"] and not any(r.reparameterised for r in found)


def test_tables_of_numbers_meet_by_their_own_words_only(spark):
    """Windows of placeholders are no common key: meetings do not grow with the product of two tables."""
    number = lambda seed, n: " ".join(str(random.Random(f"{seed}{i}").randrange(10 ** 6)) for i in range(n))
    bench = tp.benchmark_windows(_items(spark, [(1, number("a", 3000))]), "item_id", "text").cache()
    docs = documents(spark, [(1, number("b", 3000)), (2, number("c", 40) + " " + " ".join(number("a", 3000).split()[50:63]))])
    assert tp.meetings(docs, "doc_id", "text", bench).count() == 6
    assert set(_leaks(spark, [(1, number("b", 3000)), (2, " ".join(number("a", 3000).split()[50:63]))], [(1, number("a", 3000))])) == {(2, 1)}


def test_leaks(spark):
    other = QUESTION.replace("Alice", "Carol").replace("12", "48").replace("5 km", "9 miles").replace("Bob", "Dan")
    twice = QUESTION.replace("12 apples", "48 apples", 1)
    docs = [(1, f"{text(1, 80)} {QUESTION} {text(2, 40)}"), (2, text(3, 50) + "\n" + other), (3, text(4, 200)), (4, None), (5, ""),
            (6, text(50, 30).upper().lower()), (7, "intro " + " ".join(text(50, 30).split()[:6])), (8, text(51, 6) + " " + text(7, 30)),
            (9, twice), (9, twice), (10, "Alice has 12 apples"), (11, " ".join(words(random.Random(1), 20_000)) + " " + text(50, 30))]
    got = _leaks(spark, docs, ITEMS)
    assert set(got) == {(1, 1), (2, 1), (6, 2), (6, 6), (8, 5), (9, 1), (11, 2), (11, 6)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised and got[9, 1].reparameterised
    assert got[11, 2].first_token == 20_000


def test_items_of_few_literals_short_items_and_extracts(spark):
    """Items of one to three words are leaked only by a text that is nothing else."""
    dense, long, units = "Tom has 3 apples. Anna has 4 pears.", text(60, 100), "take 7 " + "km " + text(61, 90)
    items = [(1, dense), (2, "Four plain words here"), (3, long), (4, units), (5, "x9")]
    row = lambda t, a, b: " ".join(t.split()[a:b])
    docs = [(1, f"{text(62, 40)} {dense} {text(63, 40)}"), (2, dense.replace("Tom", "Ivy")), (3, f"{text(64, 9)} Four plain words here."),
            (4, "four plain other words here"), (5, f"{text(65, 50)} {row(long, 30, 55)} {text(66, 50)}"), (6, f"{text(67, 20)} {row(long, 30, 42)} {text(68, 20)}"),
            (7, f"{text(69, 20)} {row(units, 2, 15)} {text(70, 20)}"), (8, "an x9 here"), (9, " X9! ")]
    got = _leaks(spark, docs, items)
    assert set(got) == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)} and not any(r.reparameterised for r in got.values())


def test_inconsistent_slots_do_not_count(spark):
    """The same name of the question stands for two names: half of the windows fall out."""
    names = " ".join(f"Ann likes thing{i} very much today because it shines" for i in range(8))
    mixed = " ".join(f"{'Eve' if i % 2 else 'Ivy'} likes thing{i} very much today because it shines" for i in range(8))
    assert (1, 1) in _leaks(spark, [(1, names.replace("Ann", "Eve"))], [(1, names)])
    met = _leaks(spark, [(1, names.replace("Ann", "Eve"))], [(1, names)])[1, 1].windows_met
    split = _leaks(spark, [(1, mixed)], [(1, names)])
    assert not split or split[1, 1].windows_met < 0.7 * met


def test_templates(spark):
    row = spark.createDataFrame([("Paris, 3.5 km! 12kg UPPER café's 1,000 dollars",)], "t string")
    got = row.select(tp.template(tp.clean(F.col("t"))).alias("t"), tp.clean(F.col("t")).alias("c")).first()
    assert got.t == "#p #n #u #n upper café s #n #u" and len(got.c.split()) == len(got.t.split())


def test_leak_stage_and_empty_tables(spark, tmp_dir):
    _items(spark, ITEMS).write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = clashing(documents(spark, [(1, QUESTION), (2, text(3, 50)), (None, text(4, 20)), (3, None)]))
    out = tp.decontaminated(spark, docs, tmp_dir)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "None"]
    assert not _leaks(spark, [], ITEMS) and not _leaks(spark, [(1, QUESTION)], [])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site name of the week</h1><p>Our motto is long enough to be text</p></header><nav><ul><li><a href="/a">Home page</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, accept them all</div>{body}
<aside><p>Read this other long and interesting story as well</p></aside><form><label>Your mail</label><input></form>
<section id="comments"><article class="comment"><p>First! I have a long opinion about everything in here and more.</p></article></section>
<footer>&copy; all rights and wrongs reserved forever</footer></body></html>"""
BODY = ("<article><h1>Head &amp; tail</h1><div class='ad banner'>Buy now</div><p>First  paragraph\nwith <b>bold</b>, a <a href='#'>link</a> &eacute;&#233;.</p>"
        "<p>Ok.</p><ul><li>one</li><li>two</li></ul><p>Last paragraph of the text is a bit longer than the others.</p></article>")
TEXT = "Head & tail\nFirst paragraph with bold, a link éé.\nOk.\none\ntwo\nLast paragraph of the text is a bit longer than the others."


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt;\n here", "plain <text> here"), ("<p></p><br>", ""),
    (PAGE.format(body=BODY), TEXT),
    (PAGE.format(body=BODY.replace("article>", "main>").replace("<article", "<main")), TEXT),
    (PAGE.format(body=BODY).split("</article>")[0], TEXT),  # cut off
    (PAGE.format(body="<nav><a>Never closed menu" + BODY), TEXT),
    ("<div><p>No article at all but a paragraph that is long enough to count.</p><p>Second one follows it.</p></div><footer>foot</footer>",
     "No article at all but a paragraph that is long enough to count.\nSecond one follows it."),
    ("<article><p>cut char &am", "cut char &am"), ("<article><p>a<br>b<p>c</article>", "a b\nc"),
    ("<script>only()", ""), ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000))])
def test_main_text(html, want):
    assert main_text(html) == want


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, PAGE.format(body=BODY), "x"), (1, "u", None, None), (None, "u", "<p>a", "y")],
                                  "page_id long, url string, html string, text string").withColumn("row", F.lit(1))
    out = extract_text(pages)
    assert sorted(out.columns) == ["page_id", "row", "text", "url"]
    assert sorted(r.text for r in out.collect()) == sorted(["", TEXT, "a"])
    assert extract_text(pages.limit(0)).count() == 0


def _archive(spark, tmp_dir, rows=None):
    rows = rows if rows is not None else [(i, f"http://h/{i}", f"<p>{i} {'x' * (i % 97)}</p>") for i in range(1000)] + [(5, None, None), (None, "u", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).repartition(3)
    path = f"{tmp_dir}/a"
    return rows, path, wa.write_archive(pages, "page_id", "url", "html", path)


def test_archive_round_trip(spark, tmp_dir):
    rows, path, index = _archive(spark, tmp_dir)
    got = []
    for r in index.collect():
        with open(f"{path}/{r.file}", "rb") as f:
            f.seek(r.offset)
            headers, body = wa.parse_record(f.read(r.length))
        assert headers["WARC-Block-Digest"] == f"sha256:{r.sha256}" and len(body) == r.n_bytes
        got.append((r.page_id, headers["WARC-Target-URI"], body.decode()))
    assert sorted(got, key=str) == sorted(((a, b or "urn:none", c or "") for a, b, c in rows), key=str)


def _tree(ranges, path, name):
    return wa.MerkleTree(wa.leaves(ranges, path), name)


def test_damage_is_located(spark, tmp_dir):
    _, path, index = _archive(spark, tmp_dir)
    first = _tree(index.withColumn("stored", F.col("file")), path, "a")
    assert len(first.levels) >= 3
    copy = wa.copy_replica(index, path, f"{tmp_dir}/b", damaged="page_id in (17, 18, 700)")
    second = _tree(copy, f"{tmp_dir}/b", "b")
    assert first.root() != second.root()
    bad = wa.differing_leaves(first, second).join(index, ["file", "idx"])
    assert sorted(r.page_id for r in bad.collect()) == [17, 18, 700]
    sound = _tree(wa.copy_replica(index, path, f"{tmp_dir}/c"), f"{tmp_dir}/c", "c")
    assert sound.root() == first.root() and wa.differing_leaves(first, sound).count() == 0


def test_missing_and_short_files_differ(spark, tmp_dir):
    _, path, index = _archive(spark, tmp_dir)
    copy = wa.copy_replica(index, path, f"{tmp_dir}/b")
    files = sorted({(r.stored, r.file) for r in copy.collect()})
    os.remove(f"{tmp_dir}/b/{files[0][0]}")
    size = os.path.getsize(f"{tmp_dir}/b/{files[1][0]}")
    os.truncate(f"{tmp_dir}/b/{files[1][0]}", size - 1)
    bad = wa.differing_leaves(_tree(index.withColumn("stored", F.col("file")), path, "a"), _tree(copy, f"{tmp_dir}/b", "b"))
    got = {(r.file, r.idx) for r in bad.collect()}
    last = max(r.idx for r in copy.collect() if r.file == files[1][1])
    assert got == {(r.file, r.idx) for r in copy.collect() if r.file == files[0][1]} | {(files[1][1], last)}


def test_no_pages(spark, tmp_dir):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_dir}/pages.parquet")
    assert wa.op9_merkle_audit(spark, tmp_dir).count() == 0
