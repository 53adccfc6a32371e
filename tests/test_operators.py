import hashlib
import math

import numpy as np
import pytest

from voicetally.functions.text import surname
from voicetally.operators import draws as D
from voicetally.operators import shares as S
from voicetally.operators import uncertainty as U
from voicetally.operators.attribution import extract_attributions, extract_with_model
from voicetally.operators.concentration import annual, concentration, concentration_of_counts
from voicetally.operators.resolve import resolve_mentions
from voicetally.operators.sampling import stratified_sample


def test_concentration(spark):
    df = spark.createDataFrame([(2000, "a")] * 50 + [(2000, "b")] * 30 + [(2000, "c")] * 20 + [(2001, "a")] * 3 + [(2001, None)], "year int, who string")
    r = {x["year"]: x for x in concentration(df, ["year"], "who").collect()}
    assert abs(r[2000]["hhi"] - 0.38) < 1e-12 and r[2000]["n_events"] == 100 and r[2000]["top10_share"] == 1
    assert (r[2001]["hhi"], r[2001]["hhi_normalized"], r[2001]["entropy_norm"], r[2001]["n_distinct"]) == (1, 1, 0, 1)
    assert concentration(df, [], "who").first()["n_events"] == 103
    with pytest.raises(Exception, match="non-negative"):
        concentration_of_counts(spark.createDataFrame([(1, "a", -1)], "year int, who string, c bigint"), ["year"], "who").collect()


def test_empty_series_keeps_columns(spark):
    s = annual(spark.createDataFrame([], "year int, canonical_id string"), "speakers", "external")
    assert s.count() == 0 and s.columns[:4] == ["year", "measure", "variant", "hhi"] and len(s.columns) == 10


def test_resolution(spark):
    names = ["John Smith", "Jane Smith", "Smith", "Jane Doe", "Doe", "Obama", "Hillary Clinton", "Clinton", "Lone", "", None, "Sen. Jane Doe"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r["canonical_id"] for r in sorted(resolve_mentions(df, "n").collect())]
    assert got == ["john smith", "jane smith", "ambiguous:smith", "jane doe", "jane doe", "barack obama", "hillary clinton", "clinton", "lone", "", "", "jane doe"]


def test_resolution_by_scope(spark):
    df = spark.createDataFrame([(1, "John Smith"), (1, "Smith"), (2, "Jane Smith"), (2, "Smith"), (3, "Smith")], "s int, n string")
    got = sorted((r["s"], r["canonical_id"]) for r in resolve_mentions(df, "n", ["s"]).collect() if r["n"] == "Smith")
    assert got == [(1, "john smith"), (2, "jane smith"), (3, "smith")]
    assert df.select(surname("n").alias("x")).first()["x"] == "Smith"


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None) for i in range(300)] + [(999, "z")], "k int, s string")
    a = sorted(map(tuple, stratified_sample(df, ["s"], 7, "k", 1).collect()))
    assert a == sorted(map(tuple, stratified_sample(df.repartition(9), ["s"], 7, "k", 1).collect()))
    assert len(a) == 22 and (999, "z") in a


def test_islands(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "a"), (5, "b"), (7, "b")], "y int, v string")
    assert sorted((r["v"], r["first"], r["last"]) for r in S.islands(df, "y", "v").collect()) == [("a", 1, 2), ("a", 4, 4), ("b", 5, 5), ("b", 7, 7)]


def test_turn_aggregate_counts_all_once_more(spark):
    t = spark.createDataFrame([(2000, "guest", "live", "x", True, "president", "R")] * 2 + [(2000, "guest", "clip", "y", False, "", None), (2000, "staff", "live", "z", False, "", None), (2000, "guest", "live", "ambiguous:q", False, "", None)], "year int, staff_flag string, source_mode string, canonical_id string, is_president boolean, office string, party string")
    a = S.turn_aggregate(t)
    assert {(r["mode"], r["canonical_id"]): r["n"] for r in a.collect()} == {("live", "x"): 2, ("clip", "y"): 1, ("all", "x"): 2, ("all", "y"): 1}
    p = {r["mode"]: r for r in S.president_share(a).collect()}
    assert abs(p["all"]["president_share"] - 2 / 3) < 1e-12 and p["live"]["president_id"] == "x" and p["clip"]["president_id"] is None
    o = {r["mode"]: r for r in S.office_share(a, ["president"]).collect()}
    assert o["clip"]["president_share"] is None and o["live"]["executive_share"] == 1 and abs(o["all"]["office_coverage"] - 2 / 3) < 1e-12
    q = {r["mode"]: r for r in S.party_share(a).collect()}
    assert abs(q["all"]["R_share"] - 2 / 3) < 1e-12 and q["clip"]["party_coverage"] == 0


def uniforms(key, draws):
    """The counter's values, by hand."""
    x = [(int(hashlib.md5(key.encode()).hexdigest()[:8], 16) + k * 0x9E3779B1) % 2**32 for k in range(draws)]
    for _ in range(2):
        x = [((v ^ v >> 16) * 0x45D9F3B) % 2**32 for v in x]
    return np.array([v ^ v >> 16 for v in x])


def test_bootstrap(spark):
    x = np.arange(30, dtype=float)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)] + [(2, 0, None)], "k int, i int, v double")
    a, b = (sorted(map(repr, U.bootstrap_ci(d, ["k"], "v", ["i"], 500).collect())) for d in (df, df.repartition(5)))
    wide = {r["k"]: r for r in U.bootstrap_ci(df, ["k"], "v", ["i"], 500, alpha=0.01).collect()}
    one = {r["k"]: r for r in U.bootstrap_ci(df, ["k"], "v", ["i"], 500).collect()}
    assert a == b and wide[1]["lo"] <= one[1]["lo"] < x.mean() < one[1]["hi"] <= wide[1]["hi"] and one[2]["lo"] is None
    # by hand: weights are Poisson draws of mean 1, and resampled means spread as means do
    w = np.array([[sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32 <= u for k in range(11)] for i in range(30) for u in uniforms(f"0|1|{i}", 4000)]).sum(axis=1).reshape(30, 4000)
    means = (w * x[:, None]).sum(axis=0) / w.sum(axis=0)
    assert np.allclose((one[1]["lo"], one[1]["hi"]), np.quantile(means[:500], [0.025, 0.975]))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(means.mean() - x.mean()) < 0.2 and abs(means.std() - x.std() / math.sqrt(30)) < 0.15
    assert U.bootstrap_ci(df.where("false"), ["k"], "v", ["i"], 5).count() == 0
    sums = U.resample_sums(df, ["k"], "v", ["i"], 50)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in sums and "Pandas" not in sums and "Arrow" not in sums


def test_draws_are_even():
    u = np.concatenate([uniforms(f"key{k}", 2000) for k in range(50)])
    assert abs(u.mean() / 2**32 - 0.5) < 0.003 and (np.abs(np.bincount(u >> 27, minlength=32) / len(u) - 1 / 32) < 0.003).all()
    lag = np.corrcoef(u[:-1], u[1:])[0, 1]
    between = np.corrcoef(uniforms("a|1", 5000), uniforms("a|2", 5000))[0, 1]
    assert abs(lag) < 0.01 and abs(between) < 0.05


@pytest.mark.parametrize("count,recall,precision", [(1, 0.7, 0.9), (7, 0.7, 0.9), (80, 0.4, 0.5), (30, 1.0, 0.8), (30, 0.6, 1.0), (5, 1.0, 1.0), (4000, 0.7, 0.9), (9, 0.7, 0.0)])
def test_quantiles_of_a_true_count(count, recall, precision):
    """Against many draws of the model itself."""
    rng = np.random.default_rng(1)
    kept = rng.binomial(count, precision, 400_000)
    true = kept + (rng.poisson(kept * (1 - recall) / recall) if recall < 1 else 0)
    q = U.quantiles(count, recall, precision)
    spread = true.std() + 1e-9
    assert len(q) == U.VALUES and (np.diff(q) >= 0).all()
    assert abs(q.mean() - true.mean()) < 0.02 * spread + 1e-9 and abs(q.std() - true.std()) < 0.03 * spread + 1e-9
    for p in (0.05, 0.5, 0.95):
        assert abs(np.quantile(q, p) - np.quantile(true, p)) <= 0.06 * spread + 1


def test_error_adjusted_hhi(spark):
    counts = [80] + [1] * 20
    df = spark.createDataFrame([(y, f"s{i}", c) for y in (1, 2) for i, c in enumerate(counts)] + [(3, "none", 0)], "y int, who string, c bigint")
    a, b = (sorted(map(tuple, U.simulate_hhi_ci(d, ["y"], "who", 0.7, 0.9, 300).collect())) for d in (df, df.repartition(5)))
    assert a == b and [r[0] for r in a] == [1, 2] and all(lo < mid < hi for _, mid, lo, hi in a)
    # by hand: the same sources' draws
    rows = np.stack([U.quantiles(c, 0.7, 0.9)[uniforms(f"0|1|s{i}", 300) * U.VALUES >> 32] for i, c in enumerate(counts)])
    hhi = (rows.astype(float) ** 2).sum(axis=0) / rows.sum(axis=0) ** 2
    assert np.allclose(a[0][1:], np.quantile(hhi, [0.5, 0.025, 0.975]))
    assert abs(rows.sum(axis=0).mean() - 100 * 0.9 / 0.7) < 3
    sure = U.simulate_hhi_ci(df, ["y"], "who", 1.0, 1.0, 10).first()
    assert abs(sure["lo"] - (80**2 + 20) / 100**2) < 1e-12 and sure["lo"] == sure["hi"]


def test_draws_are_made_in_blocks(spark):
    """No step makes a row for each source and draw; blocks are the draws by counter, nulls and several groups included."""
    base = np.array([0, 1, 2**31, 2**32 - 1], np.int64)
    x = spark.createDataFrame([(int(b), d) for b in base for d in range(70)], "b bigint, d bigint").select("b", "d", D.uniform("b", "d").alias("u"))
    got = D.block(base.astype(np.uint32), np.arange(70, dtype=np.uint32) * np.uint32(D.STEP))
    assert {(r["b"], r["d"]): r["u"] for r in x.collect()} == {(int(b), d): int(got[i, d]) for i, b in enumerate(base) for d in range(70)}
    df = spark.createDataFrame([(y, z, f"s{i}", 1 + i % 3) for y in (1, None) for z in ("a", "b") for i in range(20)], "y int, z string, who string, c bigint")
    out = U.simulate_hhi_ci(df, ["y", "z"], "who", 0.7, 0.9, 40)
    assert len(out.collect()) == 4
    assert "Generate explode" not in out._jdf.queryExecution().toString()


def test_large_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(1, "a", 4 * 10**9), (1, "b", 4 * 10**9)], "y int, who string, c bigint")
    assert abs(concentration_of_counts(df, ["y"], "who").first()["hhi"] - 0.5) < 1e-12


SENTENCES = ["Joe Biden said the plan works.", "According to Barack Obama, reform is needed.", '"It works," said Hillary Clinton today.', "The White House said it would respond.", "The weather is nice today.", "", None, "But then Jane Doe had never been asked about it."]


def test_attributions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES)], "url int, text string")
    got = {r["url"]: r for r in extract_attributions(df).collect()}
    assert {k: (r["source_span"], r["cue_verb"], r["entity_type"]) for k, r in got.items()} == {0: ("Joe Biden", "say", "PERSON"), 1: ("Barack Obama", "according to", "PERSON"), 2: ("Hillary Clinton", "say", "PERSON"), 3: ("The White House", "say", "ORG"), 7: ("Jane Doe", "ask", "PERSON")}
    assert all(SENTENCES[k][r["char_start"] : r["char_end"]] == r["source_span"] for k, r in got.items())
    # names on air count in their own row only, also where two rows have one url
    two = spark.createDataFrame([(0, SENTENCES[0], ["joe  biden"]), (0, SENTENCES[0], ["x"]), (1, SENTENCES[0], None)], "url int, text string, air array<string>")
    assert sorted(r["url"] for r in extract_attributions(two, exclude="air").collect()) == [0, 1]


def test_attributions_by_model(spark):
    def load():
        return lambda t: [{"sentence_index": 0, "char_start": 0, "char_end": 3, "source_span": t[:3], "entity_type": "PERSON", "cue_verb": "say", "pattern_id": "subj_cue", "sentence_text": t}]

    df = spark.createDataFrame([(1, "Joe said"), (2, " "), (3, None)], "url int, text string")
    assert [r["source_span"] for r in extract_with_model(df, "url", "text", load).collect()] == ["Joe"]


def test_face_validity(spark):
    cited = spark.createDataFrame([(2022, "PERSON", "joe biden")] * 2 + [(2022, "PERSON", "x")] * 3 + [(2022, "ORG", "y")] * 9, "year int, entity_type string, canonical_id string")
    want = spark.createDataFrame([(2022, "joe biden"), (2023, "z")], "year int, expected string")
    assert [(r["year"], r["ok"]) for r in S.face_validity(cited, want, 2).collect()] == [(2022, True)]
    assert not S.face_validity(cited, want, 1).first()["ok"]
