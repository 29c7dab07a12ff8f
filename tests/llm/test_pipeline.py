"""The pipeline on a small corpus, against brute force stage by stage."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex

import corpus_pipeline
from siftline.llm import quality_rules
from siftline.llm.common import written
from tests.llm.fixtures import SCHEMA, prose


def corpus(spark):
    base = prose(150, 21, 3000)
    rows = [(1, "Menu | Login\n" + base), (2, "Menu | Login\n" + base + " tail"), (3, "too short")]
    rows += [(10 + i, "Menu | Login\n" + prose(120, 100 + i, 3000)) for i in range(30)]
    rows += [(90, prose(100, 77, 3000) + " password = abcdefghijklmnop")]
    return spark.createDataFrame([(i, t, "en", "s0", len(t), "o", 1, 2) for i, t in rows], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")


def test_stages(spark):
    docs = corpus(spark)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""))
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 3 not in kept["quality rules"] and {1, 2, 10, 90} <= set(kept["quality rules"])
    assert not any("Menu | Login" in t for t in kept["line dedup"].values())
    assert set(kept["n-gram Jaccard join"]) == set(kept["line dedup"]) - {2}
    assert kept["secret scans"][90].endswith("[SECRET]")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in last.collect()} == set(kept["secret scans"])


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    clean = quality_rules.judged(docs).where("not quality.base_failed").join(labels, "doc_id")
    assert clean.where("not quality.kept").count() == 0


def test_line_dedup_spares_copies(spark):
    lines = [prose(14, 500 + i, 3000) for i in range(10)]
    copy = "\n".join(lines)
    rows = [(i, "Menu | Login\n" + copy) for i in range(17)]
    rows += [(17 + i, "Menu | Login\n" + "\n".join([*lines[:5], lines[5] + f" edit{i}", *lines[6:]])) for i in range(17)]
    rows += [(100 + i, "Menu | Login\n" + prose(60, 600 + i, 3000)) for i in range(66)]
    docs = spark.createDataFrame([(i, t, "s0") for i, t in rows], "doc_id long, text string, source string")
    cleaned = written(corpus_pipeline.own_lines(spark, docs, ""))
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert got == {i: t.removeprefix("Menu | Login\n") for i, t in rows}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.distinct_texts(spark, cleaned, "").collect()}
    assert set(kept) == {0, *range(100, 166)} and kept[0] == copy


def test_line_dedup_of_small_sources(spark):
    rows = [(i, "Menu | Login\n" + prose(60, 900 + i, 3000), "a") for i in range(19)]
    rows += [(100 + i, "Home | About\n" + prose(60, 950 + i, 3000), "b") for i in range(3)]
    rows += [(200, "Only | One\n" + prose(60, 990, 3000), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.own_lines(spark, docs, "").collect()}
    assert got == {i: t.split("\n")[1] if i < 200 else t for i, t, _ in rows}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    repeated = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    share = lambda pattern: sum(bool(regex.search(pattern, x)) for x in lines) / max(len(lines), 1)
    return not (
        len(w) < 50
        or 100 * len(repeated) > 50 * len(w)
        or not 2.5 <= sum(map(len, w)) / len(w) <= 12
        or len(re.findall(r"[#*$%&|<>]", t)) * 10 > len(w)
        or (len(lines) - len(set(lines))) * 10 > len(lines) * 4
        or sum(bool(regex.search(r"\p{L}", x)) for x in w) < 0.7 * len(w)
        or len(regex.findall(r"\p{Lu}", t)) * 10 > len(t) * 4
        or len(set(w)) * 50 < len(w)
        or share(r"^\s*[-*•●]") > 0.9
        or share(r"(\.\.\.|…)\s*$") > 0.5
    )


def components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [WORD.findall((t or "").translate(low)) for t in texts]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(a) for a in range(len(texts))], sets


def without_lines(rows):
    group, sets = components([t for _, t, _ in rows])
    pages, holding = defaultdict(set), defaultdict(set)
    for g, s, (_, text, source) in zip(group, sets, rows, strict=True):
        page = g if s else None
        if source is not None:
            pages[source].add(page)
            for line in (text or "").split("\n"):
                holding[source, line.strip(" \t\n\x0b\f\r")].add(page)
    drop = {k for k, held in holding.items() if k[1] and len(held) >= 2 and len(pages[k[0]]) >= 2 and len(held) > 0.05 * len(pages[k[0]])}
    clean = lambda t, s: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\n\x0b\f\r")) not in drop)
    return [(i, t if t is None else clean(t, s), s) for i, t, s in rows]


def first_of_each(rows):
    group, sets = components([t for _, t, _ in rows])
    best = {}
    for n, ((i, *_), g, s) in enumerate(zip(rows, group, sets, strict=True)):
        key = g if s else ("alone", n)
        place = (i is None, i or 0)
        if key not in best or place < best[key][0]:
            best[key] = (place, rows[n])
    return [row for _, row in best.values()]


def test_stages_against_brute_force(spark):
    menu = "Menu | Login\n"
    base = prose(150, 21, 3000)
    rows = [(1, menu + base, "s0"), (2, menu + base + " tail", "s0"), (2, menu + base + " tail", "s0"), (None, menu + base, "s1"), (3, "short", "s0")]
    rows += [(10 + i, menu + prose(120, 100 + i, 3000), "s0") for i in range(12)] + [(None, menu + prose(90, 300, 3000), "s1"), (None, prose(90, 301, 3000), None)]
    rows += [(40 + i, prose(80, 400 + i, 3000) + f" token=everyone_copies_{0}_it", f"s{i}") for i in range(4)]
    rows += [(50, prose(80, 450, 3000) + " password: 'own_secret_value_1' end", "s2"), (60, None, "s0"), (61, "", "s1"), (62, "word " * 90, "s1"), (63, prose(70, 460, 3000).upper(), "s1")]
    schema = "doc_id long, text string, source string, n_chars long, _row int, quality int, component string"
    docs = spark.createDataFrame([(i, t, s, 0, 1, 2, "c") for i, t, s in rows], schema).repartition(3)
    columns = docs.columns

    def after(name, docs):
        docs = written(dict(corpus_pipeline.STAGES)[name](spark, docs, ""))
        assert docs.columns == columns
        got = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        return docs, got

    rows = [x for x in rows if good(x[1])]
    docs, got = after("quality rules", docs)
    assert Counter(got) == Counter(rows)
    rows = without_lines(rows)
    docs, got = after("line dedup", docs)
    assert Counter(got) == Counter(rows) and not any(menu in t for _, t, _ in rows)
    rows = first_of_each(rows)
    docs, got = after("n-gram Jaccard join", docs)
    assert Counter((i, t) for i, t, _ in got) == Counter((i, t) for i, t, _ in rows)
    rows = [(i, t.replace("own_secret_value_1", "\0").replace("password: '\0", "[SECRET]"), s) for i, t, s in got]
    docs, got = after("secret scans", docs)
    assert Counter(got) == Counter(rows) and sum("everyone_copies" in t for _, t, _ in got) == 4
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(known.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter(tuple(r)[:5] for r in last) == want
    assert sum(r["length"] for r in last) <= 4096 * len({r["sequence_id"] for r in last})


def test_empty_table(spark, tmp_path):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
