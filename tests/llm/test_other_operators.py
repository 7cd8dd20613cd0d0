"""Near duplicates, neighbours, pages, archives and the pipeline against plain versions."""

import gzip
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sessionloom.llm import bytekit, decontaminate, html_text, jaccard_join, neighbours, quality, queries, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- 3


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def families(seed, n):
    """Copies and near copies of random texts, by few and by many edits, some in chains."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        words = rng.choices(pool, k=rng.choice([1, 3, 4, 9, 12, 30, 60, 120, 300]))
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(words))
                words = words[:at] + rng.choice([[], ["new"], ["a", "b"]]) + words[at + 1 :]
                words = words or ["x"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [1500, 3])
def test_components_as_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = [*families(tile, 60), (9001, None), (9002, " "), (9003, "A b C"), (9004, "a B c")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == [x if rows else x for x in plain_components(rows)]


def test_signatures_meet_for_every_link():
    rng = random.Random(7)
    import pyarrow as pa

    some = np.random.default_rng(3).random(1 << jaccard_join.SKETCH_BITS) < 0.5
    for n in (7, 13, 40, 200, 900):
        for _ in range(12):
            a = [f"s{i}" for i in range(n + 3)]
            b = list(a)
            for _ in range(rng.randint(1, max(1, n // 55))):
                b[rng.randrange(len(b))] = "changed"
            hashes, bounds = jaccard_join.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
            x, y = hashes[bounds[0] : bounds[1]], hashes[bounds[1] : bounds[2]]
            if jaccard_join.linked(x, y):
                for common in (np.zeros(1 << jaccard_join.SKETCH_BITS, bool), np.ones(1 << jaccard_join.SKETCH_BITS, bool), some):
                    rows, sig = jaccard_join.signatures(hashes, bounds, np.ones(2, bool), common)
                    assert set(sig[rows == 0]) & set(sig[rows == 1])


def brute_force(rows, k, share):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {x: min(d for (d, _), y in zip(rows, label) if x == y) for x in set(label)}
    return sorted((d, len(s), least[x]) for (d, _), s, x in zip(rows, sets, label))


@pytest.mark.parametrize("words, share", [(5, 80), (3, 60), (4, 95)])
def test_components_by_other_rules(spark, words, share):
    # besides random families, sets of few shingles with one word more: links at the least size
    rows = families(words, 40) + [(8000 + 2 * n + more, " ".join(f"s{n}x{i}" for i in range(n + more))) for n in range(1, 40) for more in (0, 1)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), jaccard_join.Rule(words, share)).collect()
    assert sorted(tuple(r) for r in got) == brute_force(rows, words, share)


def test_a_shingle_that_all_share_deals_nobody_out(spark):
    """Short texts with one common shingle and no link: what is gathered stays linear in their number."""
    rng = random.Random(5)
    rows = [(i, "the same four words " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(12))) for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    both = df.mapInArrow(lambda batches: jaccard_join.per_document(batches, jaccard_join.RULE), jaccard_join.ROWS)
    common = jaccard_join.zstandard.compress(jaccard_join.common_shingles(both).tobytes())
    dealt = df.select("text").mapInArrow(lambda batches: jaccard_join.per_signature(batches, common, jaccard_join.RULE), "sig long, fp long")
    assert dealt.count() <= 20 * len(rows) and dealt.groupBy("sig").count().agg({"count": "max"}).first()[0] < 10
    assert jaccard_join.join(df).where("doc_id <> component_id").count() == 0


def test_hashes_that_share_their_leading_bits(monkeypatch):
    import pyarrow as pa

    few = np.random.default_rng(1).integers(0, 40, 4000).astype(np.uint64)
    monkeypatch.setattr(jaccard_join, "window_hashes", lambda words, k: few[: max(0, len(words) - k + 1)])
    hashes, bounds = jaccard_join.shingle_sets(pa.array([" ".join("abc" for _ in range(500))] * 3))
    for a, b in zip(bounds, bounds[1:]):
        assert (np.diff(hashes[a:b].astype(np.int64)) > 0).all()


@pytest.mark.parametrize("share", [50, 60, 70, 80, 85, 90, 95])
def test_linked_sizes_are_at_most_a_band_apart(share):
    rule = jaccard_join.Rule(5, share)
    sizes = np.arange(1, 3000)
    rows, bands = jaccard_join.bands_of(sizes, rule)
    of = {}
    for n, b in zip(sizes[rows].tolist(), bands.tolist()):
        of.setdefault(n, set()).add(b)
    for a in range(1, 1500):
        most = min(a * 100 // share, 2999)
        assert a >= rule.least or most == a
        assert a < rule.least or all(of[a] & of[b] for b in range(a, most + 1))


def test_pipeline_drops_near_copies_of_its_own_rule(spark):
    # six changed words of 104: 0.836 of the shingles of four words are shared, 0.818 of those of five
    words = [f"w{i}" for i in range(104)]
    changed = [f"n{i}" if 40 <= i < 46 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "something else of no kin to them")]
    assert [c for *_, c in plain_components(rows)] == [1, 2, 3] and [c for *_, c in brute_force(rows, 5, 80)] == [1, 1, 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [1, 3]


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(1 << 40, size=int(rng.integers(20, 60)), replace=False).astype(np.uint64)) for _ in range(120)]
    sets += [np.sort(np.append(s[2:], s[0] + np.uint64(1))) for s in sets[:40]]
    found, component = jaccard_join.links_within(sets)
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.linked(sets[i], sets[j]):
                assert component[i] == component[j]
    assert all(jaccard_join.linked(sets[i], sets[j]) for i, j in found)


def test_odd_rows_in_join(odd, empty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.join(odd).collect())
    assert got.count(("1", 8, "1")) == 2 and ("2", 0, "2") in got and ("None", 1, "None") in got and len(got) == 8
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.one_of_each(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "5", "6", "None"]


def test_rows_that_share_an_id(spark):
    one, two, far = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb", "a b c d e f g h i j k l m n o p q r s t u v w x y z aa cc", "quite another text of some words"
    rows = [(5, one, 1), (5, one, 1), (5, far, 2), (7, two, 3), (8, far, 4), (9, two, 5), (3, None, 6), (3, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").repartition(3)
    kept = sorted((r["doc_id"], r["text"] or "", r["fp"]) for r in jaccard_join.one_of_each(df).collect())
    assert [k[:2] for k in kept] == [(3, ""), (5, one), (5, far)] and kept[1:] == [(5, one, 1), (5, far, 2)]
    got = sorted(tuple(r) for r in jaccard_join.join(df).collect())
    assert [(d, c) for d, _, c in got] == [(3, 3), (3, 3), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]


# ---- 6


def test_recall_of_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_neighbours(spark, sf).toPandas()
    t = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchnumpy()
    ids, x = t["vec_id"], np.stack(t["embedding"]).astype(float)
    recall = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        recall.append(len(set(ids[best]) & set(mine.vec_id)) / 10)
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, [d[ids == v][0] for v in mine.vec_id])
    assert np.mean(recall) >= 0.9


def test_odd_vectors(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [3.0, 0.0]), (None, [1.0, 0.0]), (100, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(df, 100, k=3).collect())
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 100)]
    assert [g[2] for g in got if g[0] == 100] == [0, 1, 2]
    assert neighbours.nearest(df.limit(0), 100).count() == 0
    whole = sorted(tuple(r) for r in neighbours.nearest(df, 1, k=3).collect())
    assert sorted(tuple(r) for r in neighbours.nearest(df, 1, k=3, query_block=2, cell_rows=2).collect()) == whole
    doubles = df.withColumn("embedding", df.embedding.cast("array<double>"))
    assert sorted(tuple(r) for r in neighbours.nearest(doubles, 1, k=3).collect()) == whole


def test_cells_are_ruled_out_where_vectors_have_clusters(spark):
    """With the number of clusters in step with the rows, a query visits a bounded number of cells."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 1, 24)) * 3 + rng.normal(size=(400, 50, 24)) * 0.1).reshape(-1, 24)
    x[:5000] = x[0]  # a quarter of the rows are copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(df, 100, cell_rows=250).toPandas()
    recall = []
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        recall.append(len(set(best) & set(got[got.query_id == q].vec_id)) / 10)
    assert np.mean(recall) >= 0.9
    points = x @ neighbours.directions(24)
    splits = neighbours.Splits(points[::3], 64)
    kth = np.array([np.partition(np.sqrt(((x - x[q]) ** 2).sum(1)), 11)[11] for q in range(5000, len(x), 100)])
    limit = neighbours.chi_square_point(neighbours.SURE, neighbours.M)
    met = (neighbours.gaps(points[5000::100], splits.low, splits.high) <= (limit * kth**2)[:, None]).sum(1)
    assert met.mean() < 64 / 4


def test_chi_square():
    assert abs(neighbours.chi_square(neighbours.chi_square_point(0.9, 6), 6) - 0.9) < 1e-9


# ---- 7


@pytest.fixture(scope="module")
def model():
    return html_text.labeller()


def test_labeller_on_layouts_it_has_not_seen(model):
    pages = html_text.layouts(200, 12345)
    kept = model.main_blocks([b for b, _ in pages])
    assert np.mean(np.concatenate(kept) == np.concatenate([y for _, y in pages])) > 0.98


def test_articles_of_pages(spark, sf_dir, model):
    import html

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}

    def want(page):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?[ab][^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", body))
        return "\n\n".join(p for p in parts if p)

    got = queries.op7_html_text(spark, sf_dir).collect()
    assert len(got) == len(raw) and all(r["text"] == want(raw[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_broken_markup(model):
    text = lambda p: [b.text for b in html_text.blocks(p)]
    assert text("<p>a<p>b &amp; c<!-- x --><script>if (a<b) </script>d") == ["a", "b & cd"]
    assert text("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert text("<p title='a>b'>x</p><p class='c>d'>y") == ["x", "y"]
    assert text("") == [] and text("plain &eacute;") == ["plain é"] and text("<a" * 2000)
    assert html_text.main_text(["", "<"], model)[0] == ""


def test_head_without_end_tag_and_inline_fallback():
    text = lambda p: [(b.text, b.path) for b in html_text.blocks(p)]
    head = "<html><head><meta charset=utf-8><title>T</title><script>if (a) '<p>s</p>'</script>"
    for rest in ("<body><p>x</p></body></html>", "<p>x", "<div>x</div>"):
        assert text(head + rest) == text(head + "</head>" + rest) and [t for t, _ in text(head + rest)] == ["x"]
        assert warc.plain_text(head + rest) == warc.plain_text(head + "</head>" + rest) == "x"
    assert [t for t, _ in text("<p>so <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>tex</annotation></math> and <object data=u>a map</object>.</p>")] == ["so a=b and a map."]


@pytest.mark.parametrize("tag", sorted(html_text.RAW_TAGS))
def test_elements_that_are_never_closed(tag):
    text = lambda p: [b.text for b in html_text.blocks(p)]
    assert text(f"<p>one</p><{tag}><p>two</p><p>three</p>") == ["one", "two", "three"]
    assert text(f"<p>one</p><{tag}>x<p>two</p></{tag}><p>three</p>") == ["one", "three"]


def test_labels_as_a_plain_network(spark, sf_dir, model):
    """The batched network against one that reads a page block by block, in loops."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    w, n = model.weights, html_text.HIDDEN

    def plain(page):
        paths, words, bounds, numbers = html_text.inputs(page)
        x = [
            np.concatenate([sum(w["path"][i] for i in p) / len(p) ** 0.5, sum((w["word"][i] for i in words[a:b]), np.zeros(html_text.WIDTH)) / max(1, b - a), row])
            for p, a, b, row in zip(paths, bounds, bounds[1:], numbers)
        ]
        states = {}
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h = c = np.zeros(n)
            for t in order:
                z = x[t] @ w[f"x{side}"] + w[f"c{side}"] + h @ w[f"h{side}"]
                c = sigmoid(z[n : 2 * n]) * c + sigmoid(z[:n]) * np.tanh(z[3 * n :])
                h = sigmoid(z[2 * n : 3 * n]) * np.tanh(c)
                states[side, t] = h
        return [bool(np.concatenate([states["f", t], states["b", t], x[t]]) @ w["out"][:, 0] + w["bias"][0] > 0) for t in range(len(x))]

    raw = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = [html_text.blocks(p) for p in raw] + [[]]
    assert [k.tolist() for k in model.main_blocks(found)] == [plain(p) for p in found]


def test_odd_pages(spark, model):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (2, None, "", 2), (None, "x", "<article><p>Hello there, this is some text that is long enough.</p></article>", 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(df, model).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0] and html_text.extract(df.limit(0), model).count() == 0


# ---- 10


def test_derivatives_keep_links_and_digests(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.responses(pages)
    got = warc.derivatives(records, "page_id", "long").collect()
    assert len(got) == 2 * pages.count()
    source = {r["page_id"]: bytes(r["warc"]) for r in records.collect()}
    for r in got:
        named, _, block = next(warc.parse(source[r["page_id"]]))
        assert r["refers_to"] == named["warc-record-id"] and r["target_uri"] == named["warc-target-uri"] and r["warc_date"] == named["warc-date"]
        assert r["source_payload_digest"] == named["warc-payload-digest"] == warc.digest(warc.http_parts(block)[2]) and r["digest_ok"]
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"]) and r["record_id"] != r["refers_to"]
    assert queries.op10_warc(spark, sf_dir).count() == len(got)


def test_query_gives_records_that_can_be_written(spark, sf_dir):
    """Every row of the query makes a record whose block is whole and has the digest that it names."""
    rows = queries.op10_warc(spark, sf_dir).collect()
    for r in rows:
        named, _, block = next(warc.parse(warc.as_record(r.asDict())))
        assert named["warc-record-id"] == r["record_id"] and named["warc-block-digest"] == r["block_digest"] == warc.digest(block)
        assert len(block) == r["content_length"] and (r["record_type"] == "metadata" or len(block.decode()) == r["n_chars"])
    fields = [bytes(r["block"]) for r in rows if r["record_type"] == "metadata"]
    assert fields and all(b"source-warc-record-id: " in b and b"http-content-type: " in b for b in fields)


def test_results_are_handed_on_by_their_bytes(spark):
    """Many records in one row come out in several batches, and are the same records."""
    made = b"".join(warc.response(i, f"http://a/{i}", "<p>" + "word " * 200) for i in range(60))
    df = spark.createDataFrame([("k", made), ("l", gzip.compress(made)), ("m", b"")], "k string, warc binary").coalesce(1)
    rows = lambda out: sorted(tuple(r[c] for c in ("k", "record_id", "block_digest")) for r in warc.derivatives(df, "k", out_bytes=out).collect())
    assert rows(5000) == rows(1 << 26) and len(rows(5000)) == 240


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; U</title><p>x<br>y <a href='/z'>z</a>"), (2, None, None), (3, "http://b/", "é")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages), "page_id", "long")
    with open(tmp_path / "out.warc.gz", "wb") as f:
        for r in warc.packed(rows).collect():
            f.write(r["warc_gz"])
    back = [x for r in warc.read(spark, f"{tmp_path}/*.warc.gz").collect() for data, _ in warc.unpacked(bytes(r["warc"])) for x in warc.parse(data)]
    want = {r["record_id"]: (r["refers_to"], bytes(r["block"])) for r in rows.collect()}
    assert {n["warc-record-id"]: (n["warc-refers-to"], b) for n, _, b in back} == want
    meta = next(b for n, _, b in back if n["warc-type"] == "metadata" and b"http://a/" in b).decode()
    assert "title: T & U" in meta and "outlink: /z" in meta and "http-content-type: text/html; charset=utf-8" in meta
    assert any(b == b"x\ny z" for _, _, b in back)


def test_odd_records(spark):
    good = warc.response(1, "http://a/", "<p>x")
    forged = good.replace(b"<p>x", b"<p>y")
    other = warc.record("request", [("WARC-Record-ID", "<urn:uuid:1>")], b"GET /")
    image = warc.record("response", [("WARC-Record-ID", "<urn:uuid:2>")], b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\n\r\n\x89PNG")
    zipped = warc.record("response", [("WARC-Record-ID", "<urn:uuid:3>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"hello"))
    data = [("a", good + b"rubbish" + forged), ("b", other + image), ("c", None), ("d", b""), ("e", b"WARC/1.0\r\nbroken"), ("f", gzip.compress(good) + gzip.compress(zipped))]
    df = spark.createDataFrame(data, "k string, warc binary")
    got = warc.derivatives(df, "k").collect()
    assert sorted((r["k"], r["record_type"], r["digest_ok"]) for r in got if r["k"] == "a") == [("a", "conversion", False), ("a", "conversion", True), ("a", "metadata", False), ("a", "metadata", True)]
    assert [(r["record_type"], r["http_status"]) for r in got if r["k"] == "b"] == [("metadata", 404)]
    assert [bytes(r["block"]) for r in got if r["k"] == "f" and r["record_type"] == "conversion"] == [b"x", b"hello"]
    assert warc.derivatives(df.limit(0), "k").count() == 0


def test_conversions_as_a_plain_parser(spark, sf_dir):
    from html.parser import HTMLParser

    breaks = set("p div h1 h2 h3 h4 h5 h6 li ul ol tr table br hr section article header footer nav aside main blockquote pre td th dd dt dl form title head".split())

    class Plain(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.parts, self.skipped = [], 0
            self.feed(page)
            self.close()

        def handle_starttag(self, tag, _):
            self.parts += ["\0"] if tag in breaks else []
            self.skipped += tag in ("script", "style", "noscript", "template", "svg", "title")

        def handle_endtag(self, tag):
            self.parts += ["\0"] if tag in breaks else []
            self.skipped -= tag in ("script", "style", "noscript", "template", "svg", "title")

        def handle_data(self, data):
            self.parts += [] if self.skipped else [data]

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: bytes(r["block"]).decode() for r in queries.op10_warc(spark, sf_dir).where("record_type = 'conversion'").collect()}
    for page, body in pages.items():
        lines = (" ".join(x.split()) for x in "".join(Plain(body).parts).split("\0"))
        assert got[page] == "\n".join(x for x in lines if x)


def test_damaged_archives(spark):
    good, other = warc.response(1, "http://a/", "<p>x"), warc.response(2, "http://b/", "<p>" + "".join(random.Random(1).choices("abcdefgh ", k=9000)))
    broken = bytearray(gzip.compress(other))
    broken[3000:3010] = b"\xff" * 10
    short = gzip.compress(other)[:2000]
    data = [
        ("in the middle", gzip.compress(good) + bytes(broken) + gzip.compress(good)),
        ("cut off", gzip.compress(good) + short),
        ("rubbish behind", gzip.compress(good) + b"\x1f\x8b\x08rubbish"),
        ("short block", good[:-8]),
        ("two members, one record", gzip.compress(good[:100]) + gzip.compress(good[100:])),
    ]
    got = warc.derivatives(spark.createDataFrame(data, "k string, warc binary"), "k").collect()
    of = lambda k: sorted((r["record_type"], r["complete"]) for r in got if r["k"] == k and r["target_uri"] != "http://b/")
    whole = [("conversion", True), ("metadata", True)]
    assert [x for x in of("in the middle") if x[0] != "damaged"] == sorted(2 * whole) and ("damaged", None) in of("in the middle")
    assert of("cut off") == of("rubbish behind") == sorted([*whole, ("damaged", None)], key=str)
    assert of("short block") == [("conversion", False), ("metadata", False)] and of("two members, one record") == whole
    assert all(not r["complete"] and not r["digest_ok"] for r in got if r["target_uri"] == "http://b/")
    assert any(b"block-truncated-at: " in bytes(r["block"]) for r in got if r["k"] == "short block")
    assert warc.packed(warc.derivatives(spark.createDataFrame(data, "k string, warc binary"), "k")).count() == sum(r["record_type"] != "damaged" for r in got)


def test_odd_rows_in_records(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 1), (1, "u", "<p>b", 2), (1, "u", "<p>b", 2), (None, None, None, None), (2, "v", "", 3)], "page_id long, url string, html string, warc int")
    made = warc.responses(pages).collect()
    ids = [next(warc.parse(bytes(r["warc"])))[0]["warc-record-id"] for r in made]
    assert len(made) == 5 and len(set(ids)) == 4 and warc.responses(pages.limit(0)).count() == 0
    assert warc.packed(warc.derivatives(warc.responses(pages), "page_id", "long")).count() == 10
    assert warc.packed(warc.derivatives(warc.responses(pages.limit(0)), "page_id", "long")).count() == 0


# ---- the pipeline


def test_pipeline_as_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fitted = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    import pyarrow as pa

    good = [(d, t) for d, t in rows.items() if fitted.score(pa.array([t]))[0] >= 0.3]
    first = {d for d, _, c in brute_force(good, 5, 80) if d == c}
    windows = decontaminate.Windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    want = {d for d in first if not windows.scan(pa.array([rows[d]]))[3]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) < len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard_join", "decontamination", "byte_bpe"]


def test_slices_cover_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["text"])
    assert [p.num_rows for p in bytekit.slices(batch, "text", 20)] == [3, 1, 1] and not list(bytekit.slices(batch.slice(0, 0), "text"))
