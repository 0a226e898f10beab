"""Quality rules, personal data, secrets, site quality and languages against plain versions and defined edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwise.llm import language, personal_data, quality_rules, secret_scan, site_quality, textstats, url_filter

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (None, None), (5, "x"), (5, "x"), (5, "y"), (6, "e@mail.org " * 3)]


def plain_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    cover = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover)]


@pytest.mark.parametrize("most", [7, 40, 4_000_000])
def test_counts(most, monkeypatch):
    monkeypatch.setattr(textstats.passes, "__defaults__", (most,))
    r = random.Random(3)
    texts = ["", None, "a", "\n", "a\n", "\na", "a\na\n", "x y z w v x y z w v", " ", "　b c"] + ["".join(r.choice("ab \n\té#") for _ in range(r.randint(0, 70))) for _ in range(600)]
    got = textstats.text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        assert [int(got[c][i]) for c in textstats.COUNTS[:5]] == plain_counts(t), repr(t)


def test_empty_column():
    assert all(len(x) == 0 for x in textstats.text_counts(pa.array([], pa.string())).values())


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.08 else "") for _ in range(n))


def test_quality_rules_keep_prose_and_drop_junk(spark):
    r = random.Random(1)
    good = [(i, prose(r, 80)) for i in range(150)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(r, 80).split())) for i in range(10)] + [(2000 + i, prose(r, 60).upper().replace(" ", "!! ")) for i in range(10)]
    rows = quality_rules.quality_rules(spark.createDataFrame(good + junk, DOCS)).collect()
    assert all(x.kept == (x.doc_id < 1000) for x in rows) and len(rows) == 170


def test_quality_rules_edge_cases(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"n_words": F.lit("clash"), "Kept": F.lit(1), "other": F.lit(2)})
    out = quality_rules.quality_rules(docs)
    assert out.columns.count("n_words") == 1 and "other" in out.columns
    rows = out.collect()
    assert len(rows) == len(ODD) and not any(x["kept"] for x in rows)
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_em_prefers_the_prior_on_certain_votes():
    k = len(quality_rules.RULES)
    clean, junk = np.full((1, k), quality_rules.ABSTAIN), np.full((1, k), quality_rules.ABSTAIN)
    clean[0, -3:] = junk[0, -3:] = quality_rules.GOOD
    junk[0, 0] = quality_rules.BAD
    post, rates = quality_rules.fit_votes(np.vstack([clean, junk]), np.array([930.0, 70.0]))
    assert post[0] > 0.9 and post[1] < 0.1 and rates[0, 0] > 0.5 and rates[-1, 0] < 0.05


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


def plain_personal(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    )
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m[0])] for k, p, ok in kinds]


def plain_secrets(t):
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    found = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m))
    return [f"{k}:{a}:{b}" for a, _, b, k in found]


def sha(xs):
    return hashlib.sha256(",".join(xs).encode()).hexdigest()


def messy(seed, alphabet, n=300):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_personal_data_base(spark):
    texts = messy(1, ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "001.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (212) 555-0100", "+", "1", "é", "\U0001F600", " ", "-", "x"]) + ["x@y.z " * 400, "1" * 3000, "a" * 5000 + "@"]
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    got = personal_data.digest(personal_data.personal_data(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append((x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256))
    for i, t in enumerate(texts):
        if i not in (1, 2, 3, 5, 6):
            want = plain_personal(t)
            assert by[i] == [(*map(len, want), sha(sum(want, [])))], t
    assert personal_data.digest(personal_data.personal_data(spark.createDataFrame([], DOCS))).count() == 0


def test_personal_data_bootstraps(spark):
    r = random.Random(2)
    rows = [(i, f"{prose(r, 6)} mailto: u{i}@site.org thanks {prose(r, 6)}") for i in range(30)] + [(100, "so mailto: someone(at)9site thanks you"), (101, prose(r, 30) + " 12345")]
    got = {x.doc_id: x for x in personal_data.digest(personal_data.personal_data(spark.createDataFrame(rows, DOCS))).collect()}
    assert got[100].n_found == 1 and got[100].spans == f"email:11:{11 + len('someone(at)9site')}" and got[101].n_found == 0 and got[0].n_found == 0


def test_secrets_base(spark):
    texts = messy(5, ["password=", "Token: ", "api_key", "apikey='", "secret", "=", "AKIA", "ABCDEFGHIJ12", "abcdef0123456789" * 2, "x", "é", "\U0001F600", " ", "\n", ":", "abcdefgh"]) + ["token=token:abcdefgh", "PASSWORD = \"Zz+/_.=-12\"", "f" * 4000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in secret_scan.digest(secret_scan.secret_scan(spark.createDataFrame(rows, DOCS))).collect()}
    for i, t in rows:
        want = plain_secrets(t)
        assert got[i].base_sha256 == sha(want) and got[i].n_assign + got[i].n_access + got[i].n_hex == len(want), t


def test_secrets_link_parts(spark):
    weak = "aB3" + "xY9" * 12 + "Q"
    rows = [
        (1, f"user=alice then {weak}"), (2, f"only {weak}"), (3, "user=alice only"), (4, f"user=alice {'x ' * 200} {weak}"), (5, f"user=alice\n\n{weak}"),
        (6, f"https://host.example/api user=alice {weak}"), (7, "https://host.example/api"), (8, "AKIA" + "A" * 16 + f" {weak}"),
    ]
    apart = [(10 + i, t) for i, t in rows] + ODD
    got = {x.doc_id - 10: x for x in secret_scan.digest(secret_scan.secret_scan(spark.createDataFrame(apart, DOCS))).collect() if x.doc_id}
    assert len(weak) == 40 and [got[i].n_found for i in (1, 2, 3, 4, 7)] == [2, 0, 0, 0, 0]
    assert got[5].n_found == 0 and got[6].n_found == 3 and got[8].n_found == 1
    assert got[6].spans.split(",")[0] == "endpoint:0:24"


def test_redaction_keeps_rows_and_columns(spark):
    weak = "aB3" + "xY9" * 12 + "Q"
    rows = [(1, "a password=12345678 b"), (1, "a password=12345678 b"), (2, f"user=alice {weak} z"), *ODD]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_key", F.lit("mine"))
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = [x.text for x in out.where("doc_id in (1, 2)").collect()]
    assert texts.count("a [secret] b") == 2 and "[secret] [secret] z" in texts


def test_site_quality(spark):
    r = random.Random(4)
    rows = [(i, prose(r, 60) if i % 5 else " ".join(w + "&&&" for w in prose(r, 60).split()), f"s{i % 7}", "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(900, None, None, None), (901, "", "s1", None)], DOCS + ", source string, lang string")
    got = {x.doc_id: x for x in site_quality.site_quality(docs, labels).collect()}
    assert sum(got[i].kept != (i % 5 > 0) for i in range(300)) == 0 and len(got) == 302
    assert all(0 < x.prior < 1 for x in got.values())
    assert site_quality.site_quality(docs.limit(0), labels).count() == 0
    assert site_quality.site_quality(docs, labels.limit(0)).count() == 302


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.2)] * 400 + [("mid", "p", 0.9)] * 400 + [("tiny", "p", 0.9)]
    got = {x._site: x.prior for x in site_quality.shrunk(spark.createDataFrame(rows, "site string, path string, p double")).collect()}
    assert abs(got["big"] - 0.2) < 0.05 and got["mid"] > got["tiny"] > 0.5


def test_languages(spark):
    r = random.Random(6)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "acht", "quatsch"]}
    text = lambda x: " ".join(r.choice(words[x]) for _ in range(60))
    labelled = spark.createDataFrame([(text(x), x) for x in ("aa", "bb") for _ in range(20)], "text string, lang string")
    page = lambda lang, x: f'<html lang="{lang}"><script>zwei acht</script><p>{text(x)}</p></html>'
    rows = [(1, "http://h.org/aa/1", page("aa", "aa")), (2, "http://h.org/x/1", page("aa", "bb")), (3, "http://h.bb/1", None), (4, None, None), (5, "http://only.org/bb/9", "<html></html>")]
    got = {x.page_id: x for x in language.languages(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled).collect()}
    assert [got[i].lang for i in (1, 2, 3, 5)] == ["aa", "bb", "bb", "bb"] and got[4].lang in ("aa", "bb") and len(got) == 5
    assert abs(sum(x.probability <= 1 for x in got.values())) == 5
    assert language.languages(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled.limit(0)).where("lang is null").count() == 5


def plain_url(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[1])) if fit else None


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_url_rules(spark):
    urls = ["http://www.Example.com/en/1", "https://example.com/en/2?x", "http://a.example.com/en/", "http://example.com#f/en/", "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/", None, "", "mailto:x", "a://b://c/d", "http://É.COM/x", "http://h.org/p/1", "http://h.org/p/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Path", F.lit("clash"))
    got = {x.page_id: x for x in url_filter.url_filter(pages, RULES).collect()}
    for i, u in enumerate(urls):
        host, path, fit = plain_url(u, RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, fit[1] if fit else None), u
        assert got[i].verdict == (fit[0] if fit else "allow")
    assert url_filter.url_filter(pages.limit(0), RULES).count() == 0


def test_url_templates(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    labelled = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)], "page_id long, bad int")
    got = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], labelled).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(400))
    assert {x.template for x in got.values()} == {"/spam/<n>", "/news/<n>"}
    same = spark.createDataFrame([(i, i % 7 == 0) for i in range(400)], "page_id long, b boolean").select("page_id", F.col("b").cast("int").alias("bad"))
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], same).collect()
    assert {x.template for x in got} == {"/*/<n>"} and {x.verdict for x in got} == {"allow"}


def test_personal_data_bootstraps_from_copies(spark):
    """Seeds in documents that are copied many times teach as much as seeds that occur once."""
    r = random.Random(12)
    seeds = [(i, f"{prose(r, 6)} mailto: u{i % 10}@site.org {prose(r, 7)}") for i in range(10)]
    rows = [(i + 1000 * c, t) for i, t in seeds for c in range(20)] + [(100, "so mailto: someone(at)9site thanks you")]
    got = {x.doc_id: x for x in personal_data.digest(personal_data.personal_data(spark.createDataFrame(rows, DOCS))).collect()}
    assert got[100].spans == f"email:11:{11 + len('someone(at)9site')}" and sum(x.n_found for x in got.values()) == 1


def test_personal_data_finds_groups_and_far_contexts(spark):
    """An identifier in groups is one span; long context words and wide gaps still are contexts."""
    r = random.Random(13)
    long = "contact" * 8
    rows = [(i, f"{prose(r, 6)} tel: +44 20 7946 {1000 + i} ok {prose(r, 6)}") for i in range(30)]
    rows += [(100 + i, f"{prose(r, 6)} {long} v{i}@site.org done {prose(r, 6)}") for i in range(30)]
    tails = [(200, "so tel: 020 7946 0958 ok then"), (201, f"so {long} someone(at)9site done then"), (202, f"so tel:{' ' * 90}(020) 7946-0958 ok then"), (203, "run 10.0.0.1 555 1234 and 7 8")]
    got = {x.doc_id: x.spans for x in personal_data.digest(personal_data.personal_data(spark.createDataFrame(rows + tails, DOCS))).collect()}
    text = dict(tails)
    at = lambda i, v: f"{text[i].index(v)}:{text[i].index(v) + len(v)}"
    assert got[200] == "phone:" + at(200, "020 7946 0958") and got[201] == "email:" + at(201, "someone(at)9site")
    assert got[202] == "phone:" + at(202, "(020) 7946-0958") and got[203] == "ip:" + at(203, "10.0.0.1")


def test_candidates_are_whole_runs():
    found = lambda t: re.findall(personal_data.CANDIDATE, t)
    assert found("tel: 020 7946 0958, or") == ["020 7946 0958,"] and found("4111 1111 1111 1112") == ["4111 1111 1111 1112"]
    assert found("3, 4 cats 5x u@y 12 6  7") == ["3,", "4", "5x", "u@y", "12 6", "7"]


def test_secrets_of_other_lengths_link(spark):
    """Random-looking strings of many lengths and alphabets link; distance counts from end to start; no part meets itself."""
    values = ["aB3" + "xY9zQ7"[: n % 7] + "kL5-w_R2"[: n % 9] + "M8" * n for n in (6, 9, 15, 20)] + ["q1W2e3R4t5Y6u7I8" * 5 + "aB3dE6==", "aB3/xY9+" * 5 + "Qw=", "aB3" + "xY9" * 12 + "Q"]
    rows = [(i, f"user=alice then {v}") for i, v in enumerate(values)] + [(50 + i, f"AccountName=shop;AccountKey={v}") for i, v in enumerate(values)]
    rows += [(100, f"user={'long' * 60} then {values[0]}"), (101, f"user: {values[-1]}"), (102, f"{values[0]} {'x ' * 90} user=alice"), (103, f"{values[0]} {'x ' * 110} user=alice"), (104, f"only {values[0]}")]
    rows += [(105, f"user=alice https://{values[-1]}@host.example/x")]
    got = {x.doc_id: x.n_found for x in secret_scan.digest(secret_scan.secret_scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(got[i] == 2 and got[50 + i] == 2 for i in range(len(values))), got
    assert [got[i] for i in range(100, 106)] == [2, 0, 2, 0, 0, 3]


def test_url_branches_need_evidence_not_share_or_depth(spark):
    """A bad section below 2% of a large host is blocked; so is a bad branch at the sixth level, and a lone deep path ends."""
    rows = [f"http://big.org/s{i % 40}/{i}" for i in range(4000)] + [f"http://big.org/spam/{i}" for i in range(60)]
    rows += [f"http://deep.org/a/b/c/d/e/{'bad' if i % 2 else 'good'}/{i}" for i in range(400)] + ["http://lone.org/" + "/".join(f"x{i}" for i in range(400)) + "/7", "http://lone.org/"]
    rows = list(enumerate(rows))
    bad = spark.createDataFrame([(i, int("/spam/" in u or "/bad/" in u)) for i, u in rows], "page_id long, bad int")
    got = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), [], bad).collect()}
    assert len(got) == len(rows) and all(got[i].verdict == ("block" if "/spam/" in u or "/bad/" in u else "allow") for i, u in rows)
    assert {x.template for x in got.values() if x.host == "deep.org"} == {"/a/b/c/d/e/bad/<n>", "/a/b/c/d/e/good/<n>"}
    assert {x.template for x in got.values() if x.host == "lone.org"} == {"", "/*" * 400 + "/<n>"}


@pytest.mark.parametrize("seed", range(4))
def test_em_recovers_known_accuracies(seed):
    """Simulated rules of known accuracy that abstain at random: EM finds how often each is wrong on good and right on bad documents."""
    g, k, n = np.random.default_rng(seed), 6, 200_000
    rates = g.uniform(0.01, 0.08, (k + 1, k))
    for step in range(3):  # a failure shows in three rules
        rates[np.arange(k), (np.arange(k) + step) % k] = g.uniform(0.7, 0.95, k)
    rates[-1] = g.uniform(0.005, 0.06, k)
    kind = g.choice(k + 1, n, p=[0.05] * k + [0.7])
    bad, abstains = g.random((n, k)) < rates[kind], g.random((n, k)) < 0.25
    votes = np.where(abstains, quality_rules.ABSTAIN, np.where(bad, quality_rules.BAD, quality_rules.GOOD))
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found = quality_rules.fit_votes(patterns, counts.astype(float))
    assert np.abs(found[-1] - rates[-1]).max() < 0.05
    weight = (counts * (1 - post))[:, None]
    on_bad = (weight * (patterns == quality_rules.BAD)).sum(0) / (weight * (patterns != quality_rules.ABSTAIN)).sum(0)
    assert np.abs(on_bad - bad[kind < k].mean(0)).max() < 0.05
    assert abs((counts * post).sum() / n - 0.7) < 0.05
    # its decisions are nearly as good as those by the true rates
    score = (patterns == quality_rules.BAD) @ np.log(rates.T) + (patterns == quality_rules.GOOD) @ np.log1p(-rates.T) + np.log([0.05] * k + [0.7])
    best = np.exp(score[:, -1] - np.logaddexp.reduce(score, axis=1))
    right = lambda x: ((x[which.ravel()] >= 0.5) == (kind == k)).mean()
    assert right(post) > right(best) - 0.02


def test_em_does_not_depend_on_the_number_of_documents():
    """The prior counts as a few votes: rates that the data contradict give way."""
    patterns = np.full((2, len(quality_rules.RULES)), quality_rules.GOOD)
    patterns[1, :3] = quality_rules.BAD
    found = [quality_rules.fit_votes(patterns, scale * np.array([5000.0, 5000.0])) for scale in (1.0, 1000.0)]
    for post, rates in found:
        assert post[0] > 0.9 and post[1] < 0.01 and rates[-1].max() < 0.01
    assert np.abs(found[0][0] - found[1][0]).max() < 0.05


def plain_priors(rows, ids):
    """Priors of shrunk sites and paths, each document left out of its own, from (site, path, p)."""
    n, good, sn, sgood = {}, {}, {}, {}
    for s, p, x in rows:
        n[s, p], good[s, p] = n.get((s, p), 0) + 1, good.get((s, p), 0) + x
        sn[s], sgood[s] = sn.get(s, 0) + 1, sgood.get(s, 0) + x
    mean, means = sum(sgood.values()) / sum(sn.values()), np.array([sgood[s] / sn[s] for s in sn])
    k_site = site_quality.strength(mean, (means**2).mean() - means.mean() ** 2, mean * (1 - mean) * np.mean([1 / sn[s] for s in sn]))
    site_mean = {s: (sgood[s] + k_site * mean) / (sn[s] + k_site) for s in sn}
    k_path = site_quality.strength(mean, np.mean([(good[k] / n[k] - site_mean[k[0]]) ** 2 for k in n]), mean * (1 - mean) * np.mean([1 / n[k] for k in n]))
    out = {}
    for (s, p, x), i in zip(rows, ids, strict=True):
        site = (sgood[s] - x + k_site * mean) / (sn[s] - 1 + k_site)
        out[i] = (good[s, p] - x + k_path * site) / (n[s, p] - 1 + k_path)
    return out


def test_site_priors_against_a_plain_version(spark):
    """Places from pages, columns where there are none; all labels count; a document is left out of its own prior."""
    r = random.Random(21)
    rows = [(i, prose(r, 60) if r.random() < 0.8 else " ".join(w + "&&&" for w in prose(r, 40).split()), f"s{i % 3}", "en") for i in range(160)]
    labels = [(i, r.randint(0, 1)) for i in range(0, 160, 3)]
    places = [(i, f"h{i % 11}.org", r.choice("ab")) for i in range(0, 160, 2)] + [(0, "z.org", "a"), (7, "", "x"), (None, "h0.org", "a")]
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string").withColumn("site", F.lit("clash"))
    got = {x.doc_id: x for x in site_quality.site_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), places=spark.createDataFrame(places, "doc_id long, site string, path string")).collect()}
    assert len(got) == 160 and got[0].site == "h0.org" and got[7].site == "s1"
    label, p = dict(labels), {}
    _, base = site_quality.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id", "text")
    for i in range(160):
        p[i] = label[i] if i in label else 1 / (1 + np.exp(-(got[i].evidence + base)))
    want = plain_priors([(got[i].site, got[i].path, p[i]) for i in range(160)], range(160))
    assert all(abs(got[i].prior - want[i]) < 1e-9 for i in range(160))
    assert all(abs(np.log(got[i].quality / (1 - got[i].quality)) - got[i].evidence - np.log(want[i] / (1 - want[i]))) < 1e-6 for i in range(160))


def test_language_priors_leave_the_page_out(spark):
    """Host and domain priors against a plain version; a page without evidence follows its host's other pages, a lone page votes once."""
    r = random.Random(22)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "acht", "quatsch"]}
    text = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    labelled = spark.createDataFrame([(text(x, 60), x) for x in ("aa", "bb") for _ in range(20)], "text string, lang string")
    rows = [(i, f"http://h{i % 4}.d{i % 2}.org/x/{i}", f"<p>{text('aa' if i % 4 else 'bb', 50)}</p>") for i in range(40)]
    rows += [(100, "http://h0.d0.org/y", "<p></p>"), (101, "http://lone.net/y", f"<html lang='aa'><p>{text('bb', 2)}</p>"), (102, "http://h1.d1.org/z", None), (103, None, ""), (100, "http://h0.d0.org/y", "<p></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in language.languages(pages, labelled).collect()}
    assert got[100].lang == "bb" and got[102].lang == "aa" and language.languages(pages, labelled).count() == 45
    own, of_host, of_domain, shares = [0.9, 0.1], [3.9, 0.1], [8.0, 2.0], [0.5, 0.5]
    found = spark.range(1).select(language.host_prior(*[F.array(*map(F.lit, x)) for x in (own, of_host, of_domain, shares)]).alias("x")).first().x
    for i in range(2):
        domain = (of_domain[i] - own[i] + language.DOMAIN_STRENGTH * shares[i]) / (9 + language.DOMAIN_STRENGTH)
        assert abs(found[i] - np.log((of_host[i] - own[i] + language.HOST_STRENGTH * domain) / (3 + language.HOST_STRENGTH))) < 1e-9
    assert language.languages(pages.limit(0), labelled).count() == 0


def plain_links(parts, reach):
    """Parts near which, within reach and in the same block, stand parts of the complementary roles; parts: (block, start, end, role)."""
    near = lambda a, b: a[0] == b[0] and (0 <= b[1] - a[2] <= reach or 0 <= a[1] - b[2] <= reach)
    inside = lambda a, b: a[0] == b[0] and (0 <= b[1] - a[1] <= reach or 0 <= a[1] - b[1] <= reach or 0 <= b[1] - a[2] <= reach or 0 <= a[1] - b[2] <= reach)
    out = set()
    for i, a in enumerate(parts):
        met = {b[3] for j, b in enumerate(parts) if i != j and near(a, b)}
        held = {b[3] for j, b in enumerate(parts) if i != j and inside(a, b)}
        if (a[3] == "identifier" and "secret" in met) or (a[3] == "secret" and "identifier" in met):
            out.add(i)
        # an endpoint may hold the other two
        if a[3] == "endpoint" and {"identifier", "secret"} <= held | met:
            out.add(i)
    return out


def test_interval_join_against_all_pairs(spark):
    """Identifiers and secrets link exactly where some pair lies within reach; endpoints never link where no pair could."""
    r = random.Random(31)
    rows, want, texts = [], {}, 40
    for text in range(texts):
        at, parts = 0, []
        for _ in range(r.randint(0, 12)):
            at += r.randint(0, 60)
            size = r.randint(1, 30)
            parts.append((r.randint(0, 1) if r.random() < 0.2 else at // 400, at, at + size, r.choice(("identifier", "secret", "endpoint"))))
            at += size if r.random() < 0.8 else 0
        rows += [(text, text, b, s, e, role, False) for b, s, e, role in parts]
        want[text] = {(parts[i][1], parts[i][2], parts[i][3]) for i in plain_links(parts, 50) if parts[i][3] != "endpoint"}
    found = secret_scan.linked(spark.createDataFrame(rows, "id long, k long, block int, s long, e long, role string, strong boolean").distinct(), 50).collect()
    got = {}
    for x in found:
        if x.role != "endpoint":
            got.setdefault(x.id, set()).add((x.s, x.e, x.role))
    assert {k: v for k, v in want.items() if v} == got
    ends = {(x.id, x.s, x.e) for x in found if x.role == "endpoint"}
    possible = set()
    for text in range(texts):
        parts = [(b, s, e, role) for t, _, b, s, e, role, _ in rows if t == text]
        possible |= {(text, parts[i][1], parts[i][2]) for i in plain_links(parts, 50) if parts[i][3] == "endpoint"}
    assert ends <= possible and ends


def plain_graph(items, words, rounds, threshold):
    """Scores of candidates by the same rules, in plain loops; items: (kind or None, v, l, r)."""
    edges = {}
    for kind, v, left, right in items:
        for side, word in (("L", left), ("R", right)):
            if word:
                edges[side, word, v, kind] = edges.get((side, word, v, kind), 0) + 1
    seeds, distinct = {}, {}
    for (side, word, _, kind), times in edges.items():
        if kind:
            seeds[side, word, kind] = seeds.get((side, word, kind), 0) + times
            distinct[side, word, kind] = distinct.get((side, word, kind), 0) + 1
    patterns = {p: n for p, n in seeds.items() if distinct[p] >= personal_data.MIN_SEEDS and p[1] in words}
    links = [(side, word, kind, v, times) for (side, word, v, k), times in edges.items() if k is None for (s2, w2, kind) in patterns if (s2, w2) == (side, word)]
    known = {p: n / (words[p[1]] + personal_data.SMOOTHING) for p, n in patterns.items()}
    score = {}
    for _ in range(rounds):
        odds = {}
        for side, word, kind, v, _ in links:
            odds[v, kind] = odds.get((v, kind), 0.0) + np.log1p(-min(known[side, word, kind], 0.999))
        score = {k: 1 - np.exp(x) for k, x in odds.items() if 1 - np.exp(x) >= threshold}
        known = {p: (n + sum(score.get((v, p[2]), 0.0) * times for side, word, kind, v, times in links if (side, word, kind) == p)) / (words[p[1]] + personal_data.SMOOTHING) for p, n in patterns.items()}
    return score


def test_pattern_graph_against_a_plain_version(spark):
    r = random.Random(32)
    vocabulary = ["to", "mail", "tel", "call", "at", ""]
    items = [(r.choice(("email", "phone", None, None)), f"v{r.randint(0, 25)}", r.choice(vocabulary), r.choice(vocabulary)) for _ in range(400)]
    words = {w: sum((a == w) + (b == w) for _, _, a, b in items) + r.randint(0, 60) for w in vocabulary if w}
    held = spark.createDataFrame(items, "kind string, v string, l string, r string")
    for threshold in (0.3, 0.6):
        got = {(x.v, x.kind): x.score for x in personal_data.discovered(held, spark.createDataFrame(list(words.items()), "word string, n long"), 3, threshold).collect()}
        want = plain_graph(items, words, 3, threshold)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        assert got or threshold > 0.5


def plain_templates(rows):
    """Templates by the same rules, host by host in plain loops; rows: (host, segments, bad or None)."""
    typed = lambda s: "<n>" if re.fullmatch("[0-9]+", s) else s
    out = [""] * len(rows)
    for level in range(max(len(s) for _, s, _ in rows)):
        groups = {}
        for i, (host, segments, _) in enumerate(rows):
            if len(segments) > level:
                groups.setdefault((host, out[i]), []).append(i)
        for members in groups.values():
            own, after = {}, {}
            for i in members:
                own.setdefault(typed(rows[i][1][level]), []).append(i)
            marked = [rows[i][2] for i in members if rows[i][2] is not None]
            for segment, inside in own.items():
                labels = [rows[i][2] for i in inside if rows[i][2] is not None]
                rest = len(marked) - len(labels)
                differs = False
                if labels and rest:
                    pooled = sum(marked) / len(marked)
                    gap = abs(sum(labels) / len(labels) - (sum(marked) - sum(labels)) / rest)
                    differs = gap > url_filter.Z * np.sqrt(pooled * (1 - pooled) * (1 / len(labels) + 1 / rest))
                literal = segment.startswith("<") or (len(inside) >= url_filter.MIN_COUNT and (differs or len(inside) == len(members)))
                for i in inside:
                    after[i] = f"{out[i]}/{segment if literal else '*'}"
            for i, template in after.items():
                out[i] = template
    return out


def test_template_tree_against_a_plain_version(spark):
    """Random trees up to five levels with labels, ties, repeated rows and missing labels."""
    r = random.Random(33)
    rows = []
    for _ in range(900):
        segments = [r.choice(("news", "spam", "shop", "x", str(r.randint(1, 99)))) for _ in range(r.randint(0, 5))]
        bad = None if r.random() < 0.3 else int("spam" in segments[:2] or r.random() < 0.1)
        rows.append((r.choice(("a.org", "b.org", "c.org")), segments, bad))
    rows += rows[:20]
    pages = spark.createDataFrame([(i, f"http://{h}/{'/'.join(s)}") for i, (h, s, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame([(i, b) for i, (_, _, b) in enumerate(rows) if i % 5], "page_id long, bad int")
    rows = [(h, s, b if i % 5 else None) for i, (h, s, b) in enumerate(rows)]
    got = {x.page_id: x for x in url_filter.url_filter(pages, [], labelled).collect()}
    want = plain_templates(rows)
    assert [got[i].template for i in range(len(rows))] == want
    sums, alike = {}, {}
    for (host, _, bad), template in zip(rows, want, strict=True):
        for held, key in ((sums, (host, template)), (alike, template)):
            n, b = held.get(key, (0, 0))
            held[key] = (n + (bad is not None), b + (bad or 0))
    rate = sum(b for _, b in alike.values()) / sum(n for n, _ in alike.values())
    for i, ((host, _, _), template) in enumerate(zip(rows, want, strict=True)):
        over = (alike[template][1] + url_filter.STRENGTH * rate) / (alike[template][0] + url_filter.STRENGTH)
        purity = 1 - (sums[host, template][1] + url_filter.STRENGTH * over) / (sums[host, template][0] + url_filter.STRENGTH)
        assert abs(got[i].purity - purity) < 1e-9 and got[i].verdict == ("block" if purity < url_filter.THRESHOLD else "allow")


def test_masking_base_spans(spark):
    texts = [None, "", "write to a@b.org or +1 212 555 0100", "1.2.3.4 and 4111 1111 1111 1111", "nothing", "a@b.c" * 2]
    rows = {x.doc_id: x.text for x in personal_data.masked(spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("_text", F.lit("mine"))).collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == "write to <email> or <phone>" and rows[3] == "<ip> and <card>" and rows[4] == "nothing"


def test_unclosed_markup_is_read_once(spark):
    """Thousands of scripts and comments that are not closed neither crash nor take long; closed ones go, text stays."""
    import time

    pages = [(1, "a <script>x</script> b <!-- c --> <b>d</b>"), (2, "a " + "<script>x <!-- " * 30_000), (3, "<style>" * 30_000 + "b"), (4, None)]
    start = time.time()
    got = {x.i: x.t for x in spark.createDataFrame(pages, "i int, t string").select("i", language.visible_text(F.col("t")).alias("t")).collect()}
    assert got[1].split() == ["a", "b", "d"] and got[2].split() == ["a"] and got[3].strip() == "" and got[4] is None and time.time() - start < 30


def test_url_filter_edge_cases(spark):
    """Null labels, repeated rows and labels, clashing columns and hosts without labels have defined results."""
    pages = spark.createDataFrame([(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (2, None), (None, "http://b.org/"), (3, "http://b.org/y")], "page_id long, url string").withColumns({"Template": F.lit("mine"), "_h": F.lit(1)})
    marks = spark.createDataFrame([(1, None), (1, 1), (2, 0), (None, 1)], "page_id long, bad int")
    got = url_filter.url_filter(pages, [], marks)
    assert got.count() == 5 and [c.lower() for c in got.columns].count("template") == 1
    assert {x.verdict for x in got.collect()} <= {"allow", "block"} and url_filter.url_filter(pages, [], marks.limit(0)).where("verdict = 'allow'").count() == 5


def test_long_texts_with_many_matches(spark):
    text = " ".join(f"u{i}@site.org 10.0.0.{i % 256} password=abcdefgh{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], DOCS)
    x = personal_data.digest(personal_data.personal_data(docs)).first()
    want = plain_personal(text)
    assert (x.n_email, x.n_ip, x.base_sha256) == (3000, 3000, sha(sum(want, [])))
    y = secret_scan.digest(secret_scan.secret_scan(docs)).first()
    assert y.n_assign == 3000 and y.base_sha256 == sha(plain_secrets(text))


def test_site_quality_with_repeated_ids(spark):
    """Ids that repeat in documents and labels neither multiply rows nor fail."""
    r = random.Random(41)
    rows = [(i % 50, prose(r, 40), "s", "en") for i in range(150)]
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string").withColumns({"prior": F.lit("clash"), "_id": F.lit(0)})
    got = site_quality.site_quality(docs, labels).collect()
    assert len(got) == 150 and all(0 < x.prior < 1 for x in got)


def test_deep_paths_take_few_rounds(spark):
    """Copies of a url of 2,000 segments, and pages that part deep below a common path, end within seconds."""
    import time

    deep = "/".join(f"x{i}" for i in range(2000))
    rows = [f"http://deep.org/{deep}" for _ in range(5)] + [f"http://two.org/{'/'.join(['a'] * 500)}/{s}/{'/'.join(['b'] * 300)}" for s in ("one", "two") * 20]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    bad = spark.createDataFrame([(i, int("/two/" in u)) for i, u in enumerate(rows)], "page_id long, bad int")
    url_filter.url_filter(pages, [], bad).collect()
    start = time.time()
    got = {x.page_id: x.template for x in url_filter.url_filter(pages, [], bad).collect()}
    assert time.time() - start < 30 and got[0] == "/" + deep and got[5] == "/" + rows[5].split("/", 3)[3] and got[6].count("/two/") == 1


def test_labels_of_one_page_and_the_least_count(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([(i, b) for i in range(40) for b in (0, i % 2, None)], "page_id long, bad int")
    assert {x.template for x in url_filter.url_filter(pages, [], marks).collect()} == {"/spam/<n>", "/news/<n>"}
    assert {x.template for x in url_filter.url_filter(pages, [], marks, least=21).collect()} == {"/*/<n>"}


def plain_scores(labelled, texts):
    """Tempered log likelihoods by plain counting of byte trigrams."""
    def bins(t):
        b = bytearray((t or "").encode())
        low = [c + 32 if 65 <= c <= 90 else c for c in b]
        return [((low[i] | low[i + 1] << 8 | low[i + 2] << 16) * 2654435761 % 2**32) >> (32 - language.BINS.bit_length() + 1) for i in range(len(low) - 2)]

    counts = {}
    for t, lang in labelled:
        own = counts.setdefault(lang, {})
        for x in bins(t):
            own[x] = own.get(x, 0) + 1
    out = []
    for t in texts:
        own = bins(t)
        row = [sum(np.log((c.get(x, 0) + 0.5) / (sum(c.values()) + 0.5 * language.BINS)) for x in own) for _, c in sorted(counts.items())]
        out.append([x / max(1, len(own)) * len(own) ** language.TEMPER for x in row])
    return out


def test_trigram_model_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(language, "SEEN", 50)
    r = random.Random(2)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwei acht quatsch über Öl".split(), "cc": "unus duo tres".split()}
    labelled = [(" ".join(r.choice(words[x]) for _ in range(r.randint(0, 40))), x) for x in words for _ in range(6)] + [("", "dd")]
    texts = [None, "", "ab", "LOREM Ipsum", "quatsch mit Soße " * 80, "tres acht"]
    model = language.trigram_model(spark.createDataFrame(labelled + [("ignored text", "not a code"), ("more ignored", None), ("x", "")], "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc", "dd"]
    score = language.likelihoods(spark.sparkContext.broadcast(model))
    got = [x.s for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", score("t").alias("s")).orderBy("i").collect()]
    want = plain_scores(labelled, texts)
    assert np.allclose(got, want) and all(abs(x) < 1e-12 for x in got[0])


def test_many_languages(spark):
    """2,000 language codes, tags with regions among them, neither fail nor take long."""
    import itertools
    import time

    codes = ["".join(c) for c in itertools.islice(itertools.product("abcdefghijklmnop", repeat=3), 2000)]
    labelled = spark.createDataFrame([(f"{c} {c[::-1]}{c} word{i}", c.upper() + ("-XX" if i % 2 else "")) for i, c in enumerate(codes)], "text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<p>{codes[i * 90]} {codes[i * 90][::-1]}{codes[i * 90]} word{i * 90}</p>") for i in range(20)], "page_id long, url string, html string")
    start = time.time()
    got = {x.page_id: x for x in language.languages(pages, labelled).collect()}
    assert time.time() - start < 90 and sum(got[i].text_lang == codes[i * 90] for i in range(20)) >= 18
