"""Each stage of the corpus pipeline against brute force, on a small corpus with cases of all kinds."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import pytest
from test_operators import NOT_SPACE, brute_components, brute_fingerprint, brute_hits, brute_secrets, brute_targets, lower, prose

from kgspark.llm import near_copies, toxicity
from kgspark.llm._spark import kept


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    items = [(i, prose(rng, 20, 3000)) for i in range(4)]
    for i in range(500):
        text = ". ".join(prose(rng, 12, 3000) for _ in range(rng.randrange(2, 9)))
        bad = i % 4 == 0
        if bad:
            text += f". w1 {rng.choice(['vile', 'awful'])} w2 {rng.choice(['vile', 'awful'])}. " + prose(rng, 9, 3000)
        elif i % 9 == 1 and i > 20:
            text = rows[i - 7][1] or text  # a copy
        elif i % 9 == 2:
            text += " " + rng.choice(items)[1]
        elif i % 9 == 3:
            text += ' token = "0123456789abcdef01234567" end'
        rows.append((i, text, "en", rng.choice(["hot"] * 5 + ["a", "b", None]), len(text), "extra"))
        labels.append((i, 1, int(bad)))
    rows += [(600, None, None, "a", None, "extra"), (601, "", "en", "b", 0, "extra"), (None, "no id here at all", "en", "a", 17, "extra"), (5, rows[5][1], "en", "hot", 9, "extra")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def key(r):
    return str((r.doc_id, r.text))


def test_stages(spark, corpus):
    folder, items = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontamination", "secret_scan", "source_mix"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=key)
        made = kept(stage(spark, docs, folder), name)
        after = sorted(made.collect(), key=key)
        if name != "source_mix":
            assert made.columns == columns
        if name == "toxicity":
            bad = {r.doc_id for r in before if re.search("vile|awful", r.text or "")}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
            assert len(after) == len(before) - len(bad)
        elif name == "simhash_dedup":
            of = brute_near([r.text for r in before])
            low = {}
            for r, c in zip(before, of, strict=True):
                low[c] = min(low.get(c, 10**9), r.doc_id if r.doc_id is not None else 10**8)
            assert Counter(r.doc_id if r.doc_id is not None else 10**8 for r in after) == Counter(low.values())
        elif name == "decontamination":
            hit = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in before], items) if r[5]}
            assert hit and {r.doc_id for r in after} == {r.doc_id for r in before} - hit
        elif name == "secret_scan":
            assert len(after) == len(before)
            found = 0
            for r in before:
                spans, text, at = brute_secrets(r.text), "", 0
                for s, _, _, e in spans:
                    if s >= at:
                        text += r.text[at:s] + "[REDACTED]"
                    at = max(at, e)
                text = r.text if not spans else text + r.text[at:]
                new = next(x for x in after if x.doc_id == r.doc_id and (x.text == text))
                assert new.n_chars == (len(text) if spans else r.n_chars)
                found += bool(spans)
            assert found > 10
        else:
            sizes = Counter()
            for r in before:
                sizes[r.source] += len(re.findall(NOT_SPACE, r.text or ""))
            target, taken = brute_targets(sizes), Counter()
            for r in after:
                assert 0 < r.words <= r["size"] and r.taken <= 2 * r["size"]
                taken[r.source] += r.words
            assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        docs = made
    assert Counter(map(key, corpus_pipeline.run(spark, folder).collect())) == Counter(map(key, docs.collect()))


def test_empty(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_model_is_reproducible(spark, corpus):
    folder, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    a, b = (toxicity.train(d, labels) for d in (docs, docs.repartition(7)))
    assert a[1] == b[1] and (a[0] == b[0]).all()


def brute_near(texts):
    """The component of each text, by the Jaccard similarity of all pairs."""
    sets = []
    for t in texts:
        w = re.findall(NOT_SPACE, lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(sets[i] & sets[j])
        if of[i] != of[j] and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
            of = [of[i] if x == of[j] else x for x in of]
    return of


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 3])
def test_near_copies(spark, corpus, crowd):
    """Copies with changes around the threshold, a chain, a large group, a line that most texts have, short and empty texts."""
    rng = random.Random(22)
    line, texts = prose(rng, 30, 3000), []
    for _ in range(25):
        w = prose(rng, rng.randrange(20, 120), 3000).split()
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [f"{prose(rng, rng.randrange(4, 40), 3000)} {line} {prose(rng, 5, 3000)}" for _ in range(90)]
    texts += [f"{line} {i} {i // 2}" for i in range(8)] + [f"{line} {' '.join(line.split()[: i % 9])}" for i in range(20)]
    group = prose(rng, 100, 3000).split()
    for i in range(80):
        v = list(group)
        v[rng.randrange(100)] = f"x{i}"
        texts.append(" ".join(v))
    chain = prose(rng, 90, 3000).split()
    for i in range(12):
        chain[7 * i] = "link"
        texts.append(" ".join(chain).upper())
    texts += ["one", "One", "two words", None, "", " ", "a b c d e", "a b c d e f", "a a a a a a a", "a a a a a"]
    rng.shuffle(texts)
    of = brute_near(texts)
    least = {}
    for i, c in enumerate(of):
        least.setdefault(c, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in near_copies.near_copies(docs, crowd=crowd, block=near_copies.BLOCK if crowd > 3 else 700).collect()}
    assert found == {i: least[c] for i, c in enumerate(of)}
    assert len(set(of)) < len(texts) - 100
    if crowd == near_copies.CROWD:
        folder, _ = corpus
        stays = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
        assert sorted(r.doc_id for r in stays.collect()) == sorted(least.values())
    assert near_copies.SIMILARITY == Fraction(4, 5) and near_copies.SHINGLE == 5
