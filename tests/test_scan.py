import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import semantics as S
from palimpsest.functions.patterns import jvm, scan
from palimpsest.operators import ingest, records
from palimpsest.plans import catalog

ODD = [
    None, "", " ", "\n", "continue.\n", "continue.\r\n", "Continue! ", "  please continue  ", "　please continue　", "continue\n\n", "continue.\n\n", "繼續吧。\r\n",
    "自動化繼續", "自動繼續", "執行自動", "uſer prefers dark mode", "Keep going", "TİTLE wİthİn", "ｕｓｅｒ ｐｒｅｆｅｒｓ", "review" + "x" * 161 + " was run", "review " + "é" * 158 + " was run",
    "review " + "\U0001f600" * 157 + " was run", "review " + "\U0001f600" * 160 + " was run", "préfère_user prefers", "user prefers", "DOES NOT PREFER", "Nancy 的偏好", "a/b testing of style",
]


def texts(n):
    """Odd texts, and words of all patterns in any order between any separators."""
    rng = random.Random(7)
    body = " ".join((*S._PLAIN, *S._COMPOSED))
    words = sorted(set(re.findall(r"[A-Za-z0-9]+|[一-鿿]+", body.replace("\\b", " ").replace("\\s", " "))))
    gaps = [" ", " ", " ", " ", "", "\n", ".", "。", "-", "　", " ", "_", "é", "K", "ſ", "! "]
    return ODD + ["".join(rng.choice(words if rng.random() < 0.9 else [w.upper() for w in words]) + rng.choice(gaps) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_scan_finds_what_the_jvm_finds(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3000))], "id long, text string").repartition(4, "id")
    df = df.withColumn("s", scan(F.col("text"), S._PLAIN, S._COMPOSED))
    n = F.trim(F.coalesce("s.nfkc", "text"))
    whole = S.nfkc(F.col("text"))
    differ = [F.count_if(~F.getbit("s.bits", F.lit(i)).eqNullSafe(t.rlike(jvm(p)).cast("byte"))) for i, (t, p) in enumerate([*((F.col("text"), p) for p in S._PLAIN), *((n, p) for p in S._COMPOSED)])]
    found = [F.count_if(F.getbit("s.bits", F.lit(i)) == 1) for i in range(len(differ))]
    assert df.where(~F.coalesce("s.nfkc", "text").eqNullSafe(whole)).count() == 0
    row = df.agg(F.array(*differ).alias("differ"), F.array(*found).alias("found")).first()
    assert not any(row.differ), [(*S._PLAIN, *S._COMPOSED)[i][:60] for i, n in enumerate(row.differ) if n]
    assert sum(map(bool, row.found)) > 25


def test_scanned_signals_are_the_signals(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(500))], "id long, text string")
    names = ["id", "nfkc", "durable", "directive", "explicit", "placement"]
    assert S.scanned_signals(df)[0].select(*names).orderBy("id").collect() == S.signals(df).select(*names).orderBy("id").collect()


def units(spark):
    rng = random.Random(3)
    said = ["User prefers dark mode.", "User prefers dark mode on all devices.", "User prefers dark mode, but not at night.", "User prefers notifications at night.", "User does not prefer notifications.", "User prefers notifications.", "用戶偏好深色模式。", "User prefers Vim keybindings.", "user prefers VIM keybindings!", "", "Please continue the task.", "Ｕser ｐrefers dark mode.", None]
    kinds = [*ingest.CANDIDATE_TYPES[:5], "preference_candidate", "preference_candidate"]
    first = {0: said[0], 1: "User prefers notifications at night."}
    rows = [(i if i != 5 else None, first.get(i) or rng.choice(said), rng.choice(kinds), rng.choice(["user_asserted", "user_asserted", "system_observed", "observed", "inferred"]), "user" if i in first else rng.choice(["user", "user", "system", "agent"])) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, candidate_type string, epistemic_status string, producer string").withColumn("memory_kind", F.lit("note"))


def test_first_of_each_key_is_the_record(spark):
    u, status = units(spark), F.when(F.col("doc_id") % 10 == 7, "tombstoned").otherwise("active")
    c = ingest.classified(u)
    held = c.withColumn("memory_id", F.concat(F.lit("mem_"), F.col("doc_id").cast("string"))).withColumn("status", status)
    names = ["doc_id", "memory_type", "durability", "outcome", "reason", "relation", "target"]
    expected = ingest.distilled(c, records.latest(held, ["semantic_key"], F.col("doc_id"))).select(*names).orderBy("doc_id").collect()
    got = ingest.distilled_by_first(u, "doc_id", status)
    assert got.columns == names and got.orderBy("doc_id").collect() == expected
    assert {"equivalent", "contradicts", "existing_subsumes_candidate", "candidate_subsumes_existing", "unrelated"} <= {r.relation for r in expected}


def test_distill_pipeline_goes_through_texts_once(spark, data):
    df = catalog.QUERIES["distill_pipeline"](spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") == 1 and "ReusedExchange" in plan
    # Rules that every text is held against are bits of the scan, not patterns of the JVM.
    assert not any(word in plan for word in ("credential", "rewrit", "going", "demonstrated", "explicitly"))
