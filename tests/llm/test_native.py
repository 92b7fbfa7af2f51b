"""Fingerprints, personal data and mixing against plain Python; their plans hold no Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fingerprints, mixing, pii, queries

ODD = ["block", "row", "id", "key", "epoch", "found", "base"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def test_fingerprints_of_edited_texts(documents):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(3, texts[0]), (None, "né 日本"), (500, None), (501, ""), (502, "x"), (502, "x")]
    df = documents(rows, *ODD)
    got = defaultdict(list)
    for r in fingerprints.edit_report(df).collect():
        got[r["doc_id"]].append(r)
    ordered = sorted(((i if i is not None else -1, t or "") for i, t in rows))
    off = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        mine = [r for r in got[i if i >= 0 else None] if (r["n_chars"], r["edited_sha256"]) == (len(text), digest)]
        assert mine, (i, text)
        assert all(0 <= r[c] <= 1 for r in mine for c in ("near_edited", "near_next"))
        # rows that repeat an id and text differ by what follows them
        off.append(min((r["near_edited"] - jaccard(text, edited) for r in mine), key=abs))
        off.append(min((r["near_next"] - jaccard(text, after) for r in mine), key=abs))
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.45
    prints = {i: {r["fingerprint"] for r in rs} for i, rs in got.items()}
    assert prints[0] == prints[3] and len(prints[502]) == 1 and prints[500] == prints[501]


def test_one_document_follows_itself(documents):
    row = fingerprints.edit_report(documents([(9, "a b c d")])).first()
    assert (row["n_chars"], row["near_next"]) == (7, 1.0)
    assert fingerprints.edit_report(documents([])).count() == 0


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def seeds(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_seeds_are_those_of_the_patterns(documents):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("a1 2.3@+-()4\n%é😀9b5") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "4111 1111 1111 1111", "a@b.c+d@e.f.g@h.i", "1.2.3.4.5.6.7.8", "0256.1.1.1 000255.1.1.1 0.0.0.0",
              "+1 (988) 555-2485", "1" * 9000, "a@" + "b." * 3000 + "c", "a" * 9000, " ".join(f"1.2.3.{i % 256}" for i in range(700))]
    got = {r["doc_id"]: r for r in pii.report(documents(list(enumerate(texts)), *ODD)).collect()}
    for i, text in enumerate(texts):
        want = seeds(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS]
        assert set(got[i]["spans"].split(",")) >= set(joined.split(","))


def test_context_finds_unseen_identifiers(documents):
    rows = [(i, f"please ring me at +1 (988) 555-24{i:02d} tonight") for i in range(12)]
    rows += [(50, "please ring me at 555-0199 tonight"), (51, "chapter 1234 begins"), (52, "please ring me at noon"), (None, "ring me at 555-0177")]
    rows += [(50, rows[12][1])]  # a repeated row
    got = defaultdict(list)
    for r in pii.report(documents(rows)).collect():
        got[r["doc_id"]].append(r["spans"])
    assert got[50] == ["phone:18:26"] * 2 and got[51] == [""] and got[52] == [""] and got[None] == ["phone:11:19"]
    masked = {r["doc_id"]: r for r in pii.mask(documents(rows, *ODD)).collect()}
    assert masked[50]["text"] == "please ring me at [PHONE] tonight" and masked[50]["n_chars"] == len(masked[50]["text"])
    assert masked[0]["text"] == masked[50]["text"] and masked[51]["text"] == "chapter 1234 begins" and masked[51]["key"] == "key"
    empty = documents([(1, None), (2, "")])
    assert [(r["doc_id"], r["text"]) for r in pii.mask(empty).orderBy("doc_id").collect()] == [(1, None), (2, "")]
    assert pii.mask(documents([])).count() == 0 and pii.report(documents([])).count() == 0


def test_secrets_are_found_where_their_context_is_learnt(documents):
    rnd = random.Random(9)
    code = lambda n=40: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'word {i % 3} then token = "{code()}" goes on') for i in range(12)]
    rows += [(50, 'a token = "ab12-34cd" here'), (51, f"the file {code()} lies alone"), (52, "token = none"), (53, f"é token = '{code(32)}'"), (54, "x 1.2.3.4 y")]
    got = {r["doc_id"]: r for r in pii.report(documents(rows)).collect()}
    for i, text in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in seeds(text))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    for i in range(12):
        start = rows[i][1].index('"') + 1
        assert got[i]["spans"] == f"secret:{start}:{start + 40}"
    assert got[50]["spans"] == "secret:11:20" and got[51]["spans"] == got[52]["spans"] == "" and got[53]["spans"] == "secret:11:43"
    masked = {r["doc_id"]: r["text"] for r in pii.mask(documents(rows)).collect()}
    assert masked[50] == 'a token = "[SECRET]" here' and masked[54] == "x [IP] y" and masked[51] == rows[13][1]


def test_context_adds_secrets_to_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = [(r["doc_id"], x) for r in pii.report(docs).collect() for x in r["spans"].split(",") if x.startswith("secret")]
    planted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    got = {(i, *map(int, x.split(":")[1:])) for i, x in found}
    assert planted and len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.9 * len(got)


def test_mixing_meets_entropy_and_repetition(documents):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else f"small{i % 3}") for i in range(3000)] + [(None, "x", None), (7, "", "big"), (8, None, "big")]
    light = documents(rows).select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"))
    tokens = Counter()
    for _, text, source in rows:
        tokens[source or ""] += len((text or "").split())
    total = sum(tokens.values())

    def entropy(weights):
        return -sum(w * math.log(w) for w in weights if w) / math.log(len(weights))

    for settings in (mixing.Settings(entropy=0.9, repetition=1e6, block_tokens=1000, bucket_rows=64), mixing.Settings(repetition=1.5)):
        budgets = {r["source"]: r for r in mixing.source_budgets(light, settings).collect()}
        shares = {s: t / total for s, t in tokens.items()}
        tau = next(k / 4096 for k in range(4096, -1, -1) if entropy([p ** (k / 4096) / sum(q ** (k / 4096) for q in shares.values()) for p in shares.values()]) >= settings.entropy)
        if settings.repetition > 1e3:
            z = sum(p**tau for p in shares.values())
            assert all(abs(budgets[s]["weight"] - p**tau / z) < 1e-3 for s, p in shares.items())
        assert all(b["budget"] <= settings.repetition * b["tokens"] + 1 for b in budgets.values())
        drawn = mixing.mix(light, settings).collect()
        spent = Counter()
        for r in drawn:
            spent[r["source"]] += r["tokens"]
        assert all(b["budget"] - 5 <= spent[s] <= b["budget"] for s, b in budgets.items())
        assert len({(r["doc_id"], r["source"], r["epoch"]) for r in drawn}) == len(drawn)
        by_block = defaultdict(list)
        for r in drawn:
            by_block[r["block"]].append(r["position"])
        assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_block.values())
    assert mixing.mix(light.limit(0)).count() == 0


def test_mixed_documents_keep_their_columns(documents):
    df = documents([(1, "a b", "x"), (1, "a b", "x"), (1, "c", "x"), (None, "d", None), (4, None, "x")], "copy", "block", "_row", "_id")
    got = mixing.mix_documents(df, mixing.Settings(entropy=0.0))
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "d"), (1, "a b"), (1, "a b"), (1, "c")]


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op10_mixing"])
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_native_plans_hold_no_python(spark, sf):
    for name in ("op1_fingerprints", "op7_pii", "op10_mixing"):
        plan = plan_of(queries.QUERIES[name](spark, sf))
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
