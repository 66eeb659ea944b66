"""The operators' methods against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.llm import chat, common, decontaminate, fill_middle, fingerprint, html_extract, language, merkle, mixing, ngram_join, queries, repeats, toxicity, training_order

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- shared parts


def test_words_and_hashes_do_not_depend_on_place():
    rows = ["Aa bb", "", "xx\taa\nBB", "é bb  "]
    data, offsets = common.utf8(pa.array(rows))
    hashes, _, first = common.word_hashes(data, offsets, common.NON_SPACE)
    words = [w for r in rows for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(r))]
    assert len(hashes) == len(words) and np.diff(first).tolist() == [2, 0, 3, 2]
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(0, k) for k in range(1, 10)] + [(70, 71), (71, 70), (5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 20 for i in range(20, 61)} | {k: 0 for k in range(10)} | {70: 70, 71: 70}
    assert got == want


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_and_locates_all_occurrences(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, 400)
    text[rng.integers(0, 400, 15)] = 1
    symbols = np.append(text, 0)
    index = decontaminate.FMIndex(symbols, 4, 8)
    assert decontaminate.suffix_order(symbols).tolist() == sorted(range(401), key=lambda i: symbols[i:].tolist())
    for length in (1, 3, 6):
        phrases = np.stack([text[k : k + length] for k in rng.integers(0, 390, 20)])
        low, high = index.search(phrases, np.full(20, length))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(401 - length) if (text[i : i + length] == p).all() and i + length <= 400]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_report_against_brute_force(spark):
    docs, items = table(spark, "documents").collect(), table(spark, "benchmark").collect()
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in items:
        w = find.findall(lowered(r.text))
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r.item_id))
    options = decontaminate.DecontaminateOptions(shard_words=3000, block_windows=100)  # several shards and blocks
    got = {r.doc_id: r for r in decontaminate.report(table(spark, "documents"), table(spark, "benchmark"), options).collect()}
    dirty = 0
    for r in docs:
        w, hit, found = find.findall(lowered(r.text)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(found), sha, bool(hit))
        dirty += bool(hit)
    assert dirty


def test_search_and_result_share_one_python_step(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    options = decontaminate.DecontaminateOptions(shard_words=3000, block_windows=100)
    for few in (items, items.limit(0)):
        assert steps(decontaminate.report(docs, few)) == steps(decontaminate.cleaned(docs, few)) == 1  # two keep two workers a core
    assert steps(decontaminate.cleaned(docs, items, options)) == 1
    whole, got = (sorted(decontaminate.cleaned(docs, items, o).collect()) for o in (decontaminate.DecontaminateOptions(), options))
    assert got == whole != sorted(docs.collect())


# ---------------------------------------------------------------- n-gram join


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: sets_of(t) for i, t in rows}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    keys = sorted(sets)
    for i in keys:
        for j in keys:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    of[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def variants(seed):
    """Chains of small edits around a base, so that links are neither all nor none."""
    rng = random.Random(seed)
    rows = []
    for family in range(3):
        text = [f"f{family}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(40):
            if rng.random() < 0.5:
                text = list(text)
                text[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            mine = list(text)
            for _ in range(rng.randrange(4)):
                mine[rng.randrange(150)] = f"m{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine)))
    return rows + [(900, rows[0][1].upper()), (901, ""), (902, "a b"), (903, "A  b"), (904, None)]


@pytest.mark.parametrize("block", [1024, 7])
def test_join_against_brute_force(spark, block):
    rows = variants(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs, ngram_join.JoinOptions(block=block)).collect()}
    want = brute_components(rows)
    assert got == want
    assert 5 < len({c for n, c in want.values() if n}) < 110


def test_join_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_join(spark, SF).collect()} == brute_components(rows)


def brute_stage(rows, width=5, percent=80):
    """The smallest row number of each component of (row, text), by plain comparison of all pairs."""
    sets, of = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)) if w else frozenset()
        of[i] = {i}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and of[i] is not of[j]:
                of[i] |= of[j]
                for k in of[j]:
                    of[k] = of[i]
    return {min(c) for c in of.values()}


def test_stage_of_near_duplicates_against_brute_force(spark):
    import corpus_pipeline

    text = [f"w{k}" for k in range(500)]
    changed = [f"x{k}" if k % 50 == 25 else w for k, w in enumerate(text)]  # 0.886 of three words, 0.817 of five
    longer = [f"v{k}" for k in range(500)]
    rows = variants(5) + [(1000, " ".join(text)), (1001, " ".join(changed)), (1002, " ".join(longer)), (1003, " ".join(longer + [f"y{k}" for k in range(70)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert got == brute_stage(rows)
    assert {1000, 1002} <= got and not {1001, 1003} & got


def test_stage_of_near_duplicates_decides_by_row(spark):
    import corpus_pipeline

    rows = [(i, t) for i, t in variants(6) if i < 900]
    rows += [(i + 100, t + " Z") for i, t in rows[:20]] + [(None, t) for _, t in rows[::5]] + [(None, rows[3][1])] * 7
    rows += [(2050, f"u{k} " * 3 + " ".join(f"u{k}x{j}" for j in range(30))) for k in range(2)]  # two texts under one id
    rows += [(7, " ".join(f"c{j}" for j in range(40))), (6, " ".join(f"c{j}" for j in range(40))), (7, "nothing repeats this")]
    rows += [(None, " ".join(f"n{j}" for j in range(40)))] * 30 + [(2, ""), (2, ""), (2, None), (None, " "), (None, " ")]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    roots = brute_stage(list(enumerate(t for _, t in rows)))
    assert sorted((i is None, i or 0) for i, _ in got.elements()) == sorted((rows[k][0] is None, rows[k][0] or 0) for k in roots)
    assert {t for _, t in got} >= {t for i, t in rows if i == 2050 or t == "nothing repeats this"} and got[(2, "")] == 2 and got[(None, " ")] == 2
    assert sum(n for (_, t), n in got.items() if t and t.startswith("n0 ")) == 1


# ---------------------------------------------------------------- mixing


def filled(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_targets_against_plain_filling(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 10, 200, 5000]) for s in [None, "", "a", "Z", "é", "b", "zz"]}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = filled(sizes, (5.0, 2.0, 1.0), 3)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_takes_the_lowest_keys(spark):
    docs = table(spark, "documents")
    rows = mixing.mix(docs).collect()
    place = {r.doc_id: (r.place, r.tie) for r in mixing.drawn(docs).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[source[r.doc_id]].append(r)
    for members in groups.values():
        target, total = members[0].target, sum(r.size for r in members)
        taken = sum(r.taken for r in members)
        epochs = int(target / total + 1e-9)
        chosen = sorted((r for r in members if r.size), key=lambda r: place[r.doc_id])
        more = [r.taken > epochs * r.size for r in chosen]
        assert more == sorted(more, reverse=True)
        assert abs(taken - target) <= max(r.size for r in members) / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


# ---------------------------------------------------------------- training order


@pytest.mark.parametrize("total", [1, 2, 3, 17, 256, 1000])
def test_slots_are_a_permutation(total):
    slots = training_order.feistel(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))


def test_sequences_decode_to_all_documents(spark, tmp_path):
    docs = table(spark, "documents")
    options = training_order.OrderOptions(length=128, shard=16)
    ordered = training_order.training_order(docs, options)
    training_order.write(ordered, f"{tmp_path}/shards")
    rows = training_order.read_from(spark.read.parquet(f"{tmp_path}/shards"), 0, options).collect()
    encoder = training_order.Encoder(training_order.read_vocabulary(options.vocabulary))
    slots = training_order.feistel(np.arange(len(rows)), len(rows), options)
    stream = np.concatenate([np.frombuffer(rows[s].tokens, "<u2") for s in slots])
    parts = np.split(stream, np.flatnonzero(stream == options.end) + 1)
    got = Counter(encoder.bpe.decode(p[:-1].tolist()) for p in parts if len(p) > 1)
    assert got == Counter(r.text for r in docs.collect())
    later = training_order.read_from(spark.read.parquet(f"{tmp_path}/shards"), 40, options).collect()
    assert [r.tokens for r in later] == [r.tokens for r in rows[40:]]


# ---------------------------------------------------------------- classifiers


def test_held_out_quality_and_toxicity(spark):
    for fn, label in ((queries.op3_quality_classifier, "quality"), (queries.op6_toxicity, "toxic")):
        sf = "/root/testdata/sf0.01"
        rows = fn(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
        order = sorted(rows, key=lambda r: r.score)
        rank = sum(k for k, r in enumerate(order) if r[label] == 1)
        n = sum(r[label] == 1 for r in rows)
        assert (rank - n * (n - 1) / 2) / (n * (len(rows) - n)) > 0.9, label


def test_automaton_accepts_just_the_substrings():
    word = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    go, _ = language.automaton(word)

    def accepts(s):
        at = 0
        for c in s:
            if c not in go[at]:
                return False
            at = go[at][c]
        return True

    inside = {tuple(word[i:j]) for i in range(9) for j in range(i, 10)}
    every = [(a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)]
    assert all(accepts(s) == (s in inside) for s in [*inside, *every])


def test_languages_beyond_one_block_are_parsed_in_rounds(spark):
    docs = table(spark, "documents")
    learned = language.train(docs)
    assert all(20_000 < len(r) <= 24_000 for r in learned.references.values()) and len(learned.references) > 2
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predictions(docs, learned).collect()}
    small = language.LanguageOptions(block=30_000)
    assert len(learned.blocks(small)) == len(learned.references)
    many = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predictions(docs, learned, small).collect()}
    assert many == one


def test_junk_tags_do_not_shrink_the_languages(spark):
    docs = table(spark, "documents")
    held = docs.where("crc32(cast(doc_id as string)) % 4 = 2 and lang is not null and length(text) > 20")
    junk = spark.range(300).selectExpr("id + 1000000 doc_id", "concat('qx', id, ' zw', id) text", "concat('tag', id) lang", "'s' source", "1L n_chars")
    learned = language.train(docs.unionByName(junk))
    assert learned.references.keys() >= language.train(docs).references.keys()
    assert all(len(learned.references[k]) == len(r) for k, r in language.train(docs).references.items())
    told = language.predictions(held, learned).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in told) >= 0.97 * len(told)


def test_operators_run_on_workers_that_lack_the_package(tmp_path):
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    script = tmp_path / "run.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import sys
            sys.path.insert(0, {str(repo)!r})
            from pyspark.sql import SparkSession
            spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
            spark.sparkContext.setLogLevel("OFF")
            import __spark_entry__ as entry
            for name, query in entry.queries().items():
                if name[:2] == "op" and name[2].isdigit():
                    assert query(spark, {SF!r}).count() > 0
                    print("ran", name)
            """
        )
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ran op") == 13, done.stderr[-3000:]


def test_phrases_against_longest_matches():
    parser = language.Parser.of({"x": b" the cat sat on the mat", "y": b" der hund und die katze"}, 16)
    texts = ["The cat, the hat!", "katze", "zzz", "", "on the mat the cat sat on der hund"]
    data, offsets = common.utf8(pa.array(texts))
    count, size = parser.phrases(data, offsets)
    stream, ends = common.letters(data, offsets)
    for k in range(len(texts)):
        letters = stream[ends[k] : ends[k + 1]].tobytes()
        for name, got in zip(parser.names, count[:, k]):
            reference, phrases = {"x": b" the cat sat on the mat", "y": b" der hund und die katze"}[name], 0
            for piece in (letters[i : i + 16] for i in range(0, len(letters), 16)):
                at = 0
                while at < len(piece):
                    n = 1
                    while at + n < len(piece) and piece[at : at + n + 1] in reference:
                        n += 1
                    # a letter that the reference lacks ends the phrase before it
                    if piece[at : at + 1] not in reference:
                        n = 1
                    at, phrases = at + n, phrases + 1
            assert abs(got - phrases) <= (2 if set(letters) - set(reference) else 0)


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


# ---------------------------------------------------------------- fingerprints


def test_fingerprint_query(spark):
    rows = queries.op9_fingerprints(spark, SF).collect()
    docs = sorted(table(spark, "documents").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in rows}
    for own, after in zip(docs, docs[1:] + docs[:1]):
        half = len(own.text) // 2
        edited = own.text[: len(own.text) - half] + after.text[:half]
        assert got[own.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[own.doc_id].edited_fingerprint == fingerprint.written(fingerprint.digests([edited.encode()]))[0]
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 200]) > 0.97


def test_slices_give_the_same_neighbours(spark):
    docs = table(spark, "documents")
    whole = fingerprint.fingerprints(docs).collect()
    cut = fingerprint.fingerprints(docs, fingerprint.FingerprintOptions(rows_per_slice=1)).collect()
    assert sorted(whole) == sorted(cut)


def test_counts_against_plain_windows():
    text = "Some words, and some más words.".encode()
    counts = np.zeros(256, int)
    a, b, c = fingerprint._KEYS
    for i in range(len(text) - 4):
        for salt, (j, k) in zip(fingerprint._SALTS, fingerprint._TRIPLETS):
            counts[a[text[i]] ^ b[text[i + j]] ^ c[text[i + k]] ^ salt] += 1
    q = np.sort(counts)[[63, 127, 191]]
    want = (counts[:, None] > q).sum(axis=1)
    got = fingerprint.digests([b"zz", text, b""])
    assert (got[1, 4:] == want).all() and not got[0, 4:].any()


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize(
    "page, main, loose",
    [
        ("<div id='menu'>m</div><div class='content'><h1>T</h1><p>a <b>b</b>c<p>d<br>e</div><div class='comments'>c</div>", ["T", "a bc", "d e"], []),
        ("<main><header><h1>H</h1></header><p>x</p><aside>no</aside><p>y<script>var a='</p>';</script>z</p></main>", ["H", "x", "yz"], []),
        ("<article><p>a</p><div class='ad-box'>buy</div><article class='comment'>c</article><span class=ad>x</span><p>b</article>", ["a", "b"], []),
        ("<p>one</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><form>f</form>", [], ["one", "a", "b", "1", "2"]),
        ("a &lt; b &#x26; c", [], ["a < b & c"]),
    ],
)
def test_blocks(page, main, loose):
    assert html_extract.blocks(page) == (main, loose)


def test_repeated_runs_of_a_host_are_cut(spark):
    bar = "read our other stories about gardens today"
    pages = [(k, f"http://H.example/{k}", f"<div>{bar}</div><div>page {k} tells of plant number {k} {bar}</div><div>same</div>") for k in range(4)]
    pages += [(9, "http://other.example/9", f"<div>{bar}</div>"), (8, "http://h.example/8", f"<article><p>{bar}</p></article>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"page {k} tells of plant number {k}" for k in range(4)} | {9: bar, 8: bar}


def test_text_of_a_large_host_stays(spark):
    bar = "read our other stories about gardens and trees today"
    pages, want = [], {}
    for k in range(90):
        prose = " ".join(f"p{k}w{j}" for j in range(30)) + (" on the other hand it seems" if k % 3 == 0 else "") + f" end{k}"
        short = f"<p>note {k % 9}</p>"
        html = f"<div>{bar}</div><h1>Report</h1><h2>Summary</h2><p>{prose}</p>{short}<h2>Background</h2><p>more {k}</p><div><h3>Related</h3>{bar}</div>"
        pages.append((k, f"http://big.example/{k}", html))
        want[k] = f"Report\nSummary\n{prose}\nnote {k % 9}\nBackground\nmore {k}"
    pages += [(1000 + k, f"http://big.example/copy/{k}", pages[0][2]) for k in range(200)]
    want |= {1000 + k: want[0] for k in range(200)}
    only = "<p>the very same words stand below two addresses here</p>"
    pages += [(2000 + k, f"http://twice.example/{k}", only) for k in range(4)]
    want |= {2000 + k: only[3:-4] for k in range(4)}
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_extract.extract(docs).collect()} == want


def test_page_query(spark):
    import html

    got = {r.page_id: r for r in queries.op1_html_extraction(spark, SF).collect()}
    for r in table(spark, "pages").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


NOTICE = "read our weekly letter about gardens and trees at no cost"


def test_notices_that_a_host_repeats_inside_articles_are_cut(spark):
    pages, want = [], {}

    def add(key, host, body, stays):
        pages.append((key, f"http://{host}.example/{key}", f"<html><body><article>{body}</article></body></html>"))
        want[key] = stays

    for k in range(8):
        prose = " ".join(f"p{k}w{j}" for j in range(20)) + (" as we said in the last year" if k % 2 else "") + f" end{k}"
        head = f"<h1>Plant {k}</h1><p>{prose}</p><h2>Sources</h2><p>see book {k}</p>"
        add(k, "big", f"{head}<h2>Our letter</h2><p>{NOTICE}</p><p>By Jo</p>", f"Plant {k}\n{prose}\nSources\nsee book {k}\nOur letter\nBy Jo")
        if k < 2:  # two pages tell nothing
            add(200 + k, "two", f"<p>{prose}</p><p>{NOTICE}</p>", f"{prose}\n{NOTICE}")
        # versions of one article, and one article below several addresses
        same = " ".join(f"v{j}" for j in range(40))
        add(300 + k, "versions", f"<p>{same}</p><p>version {k} has a few words of its own</p>", f"{same}\nversion {k} has a few words of its own")
        add(400 + k, "copies", f"<p>{same}</p><p>{NOTICE}</p>", f"{same}\n{NOTICE}")
        # fewer than half of the host's articles
        add(500 + k, "few", f"<p>{prose}</p>" + (f"<p>{NOTICE}</p>" if k < 3 else ""), prose + (f"\n{NOTICE}" if k < 3 else ""))
        # versions lose what other articles show to be a notice, and so do short articles; alone it stays
        body = f"<p>{same}</p><p>version {k}</p>" if k < 4 else f"<p>{prose}</p>"
        add(600 + k, "mixed", f"{body}<p>{NOTICE}</p>", f"{same}\nversion {k}" if k < 4 else prose)
        body, stays = [(f"<p>{prose}</p>", prose), (f"<p>short {k}</p>", f"short {k}"), ("", NOTICE)][max(k - 5, 0)]
        add(700 + k, "short", f"{body}<p>{NOTICE}</p>", stays)
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for more in ({}, {"slice_pages": 2, "slice_bytes": 100}):
        options = html_extract.ExtractOptions(**more)
        assert {r.page_id: r.text for r in html_extract.extract(docs, options).collect()} == want


def host_runs_by_hand(texts, run, pages, percent):
    """Of each text (blocks of words), the tokens that any common substring of enough different texts covers."""
    different = list({repr(t): t for t in texts}.values())
    need = max(pages, -(-percent * len(different) // 100))

    def substrings(block):
        if len(block) < run:
            return {(0, len(block)): ("whole", *block)}
        return {(a, b): tuple(block[a:b]) for a in range(len(block)) for b in range(a + run, len(block) + 1)}

    on = Counter(x for t in different for x in {s for block in t for s in substrings(block).values()})
    return [[{i for (a, b), x in substrings(block).items() if on[x] >= need for i in range(a, b)} for block in t] for t in texts]


def of_other_articles_by_hand(texts, marks, run, pages, percent):
    """As the marks, but of those runs only that mostly stand on articles with more other text than marked paragraphs."""
    different = {repr(t): (t, mark) for t, mark in zip(texts, marks)}.values()
    windows = lambda b: {a: tuple(b[a : a + run]) for a in range(len(b) - run + 1)}
    on = Counter(x for t, _ in different for x in {x for b in t for x in windows(b).values()})
    apart = Counter()
    for t, mark in different:
        if 2 * sum(len(b) for b, m in zip(t, mark) if run <= len(b) == len(m)) <= sum(map(len, t)):
            apart.update({x for b in t for x in windows(b).values()})
    good = {x for x in on if on[x] >= max(pages, -(-percent * len(different) // 100)) and apart[x] >= pages and 100 * apart[x] >= percent * on[x]}
    return [[{i for a, x in windows(b).items() if x in good for i in range(a, a + run)} for b in t] for t in texts]


def test_host_runs_against_all_common_substrings(spark):
    rng = random.Random(11)
    phrases = [[rng.choice("abc") + str(rng.randrange(3)) for _ in range(rng.randrange(2, 9))] for _ in range(5)]
    hosts, pages, want = [], [], {}
    for h in range(6):
        for part in ("article", "div"):
            texts = []
            for _ in range(rng.choice([2, 5, 12, 30])):
                blocks = [rng.choice(phrases) if rng.random() < 0.6 else [rng.choice("xyz") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 6))]
                blocks = [[*b, *rng.choice(phrases)] if rng.random() < 0.2 else b for b in blocks]
                texts += [blocks] * rng.choice([1, 1, 1, 3])
            hosts.append((h, part, texts))
    for h, part, texts in hosts:
        marks = host_runs_by_hand(texts, 4, 3, 50)
        if part == "article":
            marks = of_other_articles_by_hand(texts, marks, 4, 3, 50)
        for t, mark in zip(texts, marks):
            if part == "div":
                kept = [[w for i, w in enumerate(b) if i not in m] for b, m in zip(t, mark)]
            else:
                gone = [4 <= len(b) == len(m) for b, m in zip(t, mark)]
                kept = t if all(gone) else [[] if g else b for b, g in zip(t, gone)]
            want[len(pages)] = "\n".join(" ".join(b) for b in kept if b)
            inner = "".join(f"<p>{' '.join(b)}</p>" for b in t)
            pages.append((len(pages), f"https://h{h}.example/{len(pages)}", f"<{part}>{inner}</{part}>"))
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    for more in ({}, {"slice_pages": 4, "slice_bytes": 300}, {"slice_pages": 3}, {"slice_bytes": 1_000}):
        options = html_extract.ExtractOptions(run=4, **more)
        assert {r.page_id: r.text for r in html_extract.extract(docs, options).collect()} == want


# ---------------------------------------------------------------- chat


def test_conversation_query(spark):
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, SF).collect()}
    turns = defaultdict(list)
    for r in table(spark, "conversations").collect() :
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    case = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", case), (1, "assistant", case)]
    assert got.keys() == turns.keys()
    for key, rows in turns.items():
        rows.sort()
        said = "".join(t for _, role, t in rows if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in rows)
        g = got[key]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_escapes_are_undone_and_leave_no_control_string():
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", "[", "a", "\\\\", "|", ">", "s>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def render(source, **names):
    return "".join(p for p, _ in chat.compile_template(source)(**names))


def test_templates():
    assert render("{{ 'a' + 'b' | upper }}{% if 1 < 2 %}y{% elif z %}q{% else %}n{% endif %}") == "aBy"
    assert render("{% if x %}1{% elif y %}2{% else %}3{% endif %}", y=True) == "2"
    assert render("{% for m in ms %}{{ loop.index }}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"t": "a"}, {"t": None}]) == "1a,2"
    assert render("{% set k = n - 1 %}{{ k ~ 'x' }}{# gone #}", n=3) == "2x"
    folded = chat.fold(chat.parse("a{{ 'b' ~ 1 + 1 }}{% if not true %}c{% endif %}d"))
    assert [p.kind for p in folded.parts] == ["text"]
    assert list(chat.compile_template("x{% generation %}{{ t }}{% endgeneration %}y")(t="t")) == [("x", False), ("t", True), ("y", False)]


@pytest.mark.parametrize("source", ["{% for %}", "{% if a %}", "{{ a.__class__() }}", "{{ a | eval }}", "{% endfor %}", "{{ 'a }}", "{{ a b }}", "{% import os %}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(chat.TemplateError):
        render(source, a={})


def test_templates_reach_no_attributes():
    with pytest.raises(chat.TemplateError):
        render("{{ a.upper }}", a="text")
    assert render("{{ a.__class__ }}", a={}) == ""


# ---------------------------------------------------------------- Merkle manifest


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([hexed(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return levels


def way(levels, at):
    """(sibling or none, whether it stands on the left) on the way from a leaf to the root."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((level[other] if other < len(level) else None, other < at))
        at //= 2
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 31, 100])
def test_streamed_appends_build_the_tree_and_its_witnesses(size):
    leaves = [hashlib.sha256(b"%d" % k).digest() for k in range(size)]
    grown = merkle.Append(size)
    for leaf in leaves:
        grown.add(leaf)
        assert [h for h, *_ in grown.open] == sorted((h for h, *_ in grown.open), reverse=True)  # perfect subtrees of falling height
    levels = tree_levels([x.hex() for x in leaves])
    root, height = grown.close()
    assert root.hex() == levels[-1][0] and height == len(levels) - 1
    for k, leaf in enumerate(leaves):
        witness = grown.witness[k, :height].tobytes()
        assert merkle.fold(leaf, witness) == root
        assert [s.hex() for s in merkle.siblings(witness)] == [s for s, _ in way(levels, k) if s]
        if size > 1:
            assert merkle.fold(bytes(32), witness) != root


def audit_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: hexed(*(field(v) for v in (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree_levels([x[2] for x in groups[g]])
    top = tree_levels([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for k, (_, _, own, r) in enumerate(groups[g]):
            steps = way(trees[g], k) + way(top, place)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1) if tampered else own
            for sibling, left in steps:
                node = hexed(node) if sibling is None else hexed(sibling, node) if left else hexed(node, sibling)
            out.append((str(r["doc_id"]), own, trees[g][-1][0], top[-1][0], hexed(*(s for s, _ in steps if s)), node, node == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_against_brute_force(spark, height):
    docs = table(spark, "documents").unionByName(
        spark.createDataFrame([(7, "x", None, None, None), (None, "ü", "", "s", 3), (7, "x", None, None, None), (14, None, "é", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.audit(docs, merkle.ManifestOptions(block_height=height)).collect())
    want = audit_by_hand([r.asDict() for r in docs.collect()])
    assert got == want and {r[-1] for r in want} == {True, False}


# ---------------------------------------------------------------- repeated passages


def removed_by_hand(rows, window):
    """Words to remove of (key, words) rows, which come in their order."""
    seen, gone = set(), []
    for words in rows:
        out = set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                out.update(range(k, k + window))
            seen.add(run)
        gone.append(out)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{i}w{rng.randrange(30)}" for _ in range(rng.randrange(8, 60))] for i in range(6)]
    rows = []
    for k in range(120):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)[rng.randrange(5) :]
        rows.append(words)
    rows += [["a"] * 200, ["a", "b"] * 60, ["Ü\x00\x85"] * 25, rows[3], rows[3][:-1], [], ["one"]]
    texts = [rng.choice([" ", "\n", " \t\x0b "]).join(w) for w in rows]
    ids = list(range(len(texts)))
    order = ids[:]
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(5)
    options = repeats.RepeatOptions(block_bytes=3000, piece_bytes=700, shard_phrases=17, slot_bytes=2000)
    got = {r.doc_id: r for r in repeats.repeats(docs, options).collect()}
    for i, gone in zip(ids, removed_by_hand(rows, 20)):
        assert (got[i].n_words, got[i].n_removed) == (len(rows[i]), len(gone)), i
        assert got[i].kept == " ".join(w for k, w in enumerate(rows[i]) if k not in gone)
        assert {k for s in got[i].removed for k in range(s.first, s.end)} == gone


def test_automata_find_all_places_of_phrases():
    rng = random.Random(4)
    rows = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 50))) for _ in range(30)] + ["", "x  y\n" * 20]
    options = repeats.RepeatOptions(window=6, phrase=4, shard_phrases=5)
    words = repeats.Words.of(pa.array(rows))
    phrases = repeats.Phrases.of(words, options)
    flat = [w for r in rows for w in r.split()]
    chosen = phrases.standing[::3]
    patterns = {tuple(flat[k : k + 4]) for k in chosen}
    found = repeats.located(words, phrases, chosen, options)
    for k in range(len(flat)):
        inside = k + 4 <= words.first[words.row[k] + 1]
        assert (found[k] != np.iinfo(np.uint64).max) == (inside and tuple(flat[k : k + 4]) in patterns)


# ---------------------------------------------------------------- fill in the middle


def middle_by_hand(key, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_against_brute_force_and_back(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é中😀<<PSM>>  \t\n\x0b\x0c\r\x85") for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "<P", "<P>", "x" * 300_000, "ab " * 120_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fill_middle.transform(docs)
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_hand(r.doc_id, texts[r.doc_id])
    assert {r.doc_id: r.text for r in fill_middle.restored(made).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        fill_middle.restore(np.frombuffer(b"<P>a<M>b<S>c", np.uint8), np.array([0, 12]), np.array([fill_middle.PSM]))


# ---------------------------------------------------------------- hidden elements


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<p title="the hidden cost">Body text.</p>', ["Body text."]),
        ('<p>See <a title="a hidden gem" href=/hidden>the gem</a> now.</p>', ["See the gem now."]),
        ("<p data-x=' hidden '>Kept.</p>", ["Kept."]),
        ("<p hidden>Gone.</p><p>Kept.</p>", ["Kept."]),
        ('<p class="x" HIDDEN="">Gone.</p><p hidden=until-found>Gone.</p><p id=a hidden/>Gone.<p>Kept.', ["Kept."]),
        ('<p aria-hidden="false">Kept.</p>', ["Kept."]),
    ],
)
def test_only_the_attribute_named_hidden_hides(inner, want):
    main, loose = html_extract.blocks(f"<html><body><article>{inner}</article></body></html>")
    assert main == want and loose == []
