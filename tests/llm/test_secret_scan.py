import hashlib
import re

import fixtures

from minekit.llm import secret_scan

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


ASSIGN_VALUE = re.compile(ASSIGN, re.ASCII)


def base(text):
    out = []
    for m in re.finditer(ASSIGN, text, re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_columns_equal_brute_force(docs):
    got = secret_scan.digest_columns(secret_scan.find_secrets(docs))
    want = []
    for r in fixtures.rows():
        found = base(r[1] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        counts = [sum(k == kind for *_, k in found) for kind in ("assign", "access", "hex")]
        want.append(tuple(map(repr, (r[0], *counts, hashlib.sha256(joined.encode()).hexdigest()))))
    assert fixtures.pairs(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)


def test_spans_keep_the_base_and_add_vendors(docs):
    by_id = {r.doc_id: r for r in secret_scan.digest_columns(secret_scan.find_secrets(docs)).collect()}
    row = by_id[30]
    assert [x.split(":")[0] for x in row.spans.split(",")] == ["github", "live", "pem", "stripe", "live"]
    for r in fixtures.rows():
        spans = set(filter(None, by_id[r[0]].spans.split(","))) if r[1] else set()
        assert {f"{k}:{s}:{e}" for s, _, e, k in base(r[1] or "")} <= spans


def owned(spark, owners):
    value = "q7Rt9ZkP2mXw5LsB"
    data = [(i, f"before password={value} after", "en", f"o{i % owners}", None) + (None,) * 7 for i in range(12)]
    data.append((99, "mine: secret=Jk3Pz8Wq1Nv6Tb4Y", "en", "o0", None) + (None,) * 7)
    return fixtures.table(spark, data)


def test_ownership_separates_copied_values_from_live_ones(spark):
    for owners, copied in ((2, False), (3, True), (6, True)):
        for r in secret_scan.find_secrets(owned(spark, owners)).collect():
            (x,) = r.secrets
            want = (1, 1, False, True) if r.doc_id == 99 else (12, owners, copied, not copied)
            assert (x.n_repos, x.n_owners, x.copied, x.live) == want


def brute_ownership(data):
    """Per document its places with the numbers of repositories and owners that hold the value."""
    found = [(r[0], r[3], x) for r in data for x in ASSIGN_VALUE.finditer(r[1] or "") if len(x[2]) >= 12]
    out = {r[0]: [] for r in data}
    for doc, _, x in found:
        repos = {d for d, _, y in found if y[2] == x[2]}
        owners = {o for _, o, y in found if y[2] == x[2]}
        copied = len(repos) >= secret_scan.COPIED_REPOS or len(owners) >= secret_scan.COPIED_OWNERS
        out[doc].append((x.start(), x.end(), len(repos), len(owners), copied))
    return out


def test_verdict_by_repositories_and_owners_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "COPIES_A_PART", 7)  # the copies of one text meet their verdict in parts
    values = {"wide": "q7Rt9ZkP2mXw5LsB", "hot": "Vb6Nm8Kj2Hg4Fd1S", "few": "Jk3Pz8Wq1Nv6Tb4Y", "edge": "Lw9Xc7Vb5Nm3Qz1R"}
    texts = {k: f"config password={v} end" for k, v in values.items()}
    data = [(i, texts["wide"], "en", f"o{i % 5}") for i in range(8)]
    data += [(100 + i, texts["hot"], "en", "one") for i in range(50)]
    data += [(200 + i, texts["few"] + " " + texts["hot"] * (i == 0), "en", "one") for i in range(4)]
    data += [(300 + i, texts["edge"] + f" {i}", "en", None) for i in range(secret_scan.COPIED_REPOS - 1)]
    data += [(400, "nothing", "en", "one"), (401, None, "en", "one")]
    df = fixtures.table(spark, [(*r, None) + (None,) * 7 for r in data])
    found = secret_scan.find_secrets(df)
    got = {r.doc_id: [(x.start, x.end, x.n_repos, x.n_owners, x.copied) for x in r.secrets] for r in found.collect()}
    want = brute_ownership(data)
    assert got == want and found.count() == len(data)
    assert all(want[100 + i][0][4] for i in range(50)) and not want[201][0][4] and not want[300][0][4]
    columns = {r.doc_id: r for r in secret_scan.digest_columns(found).collect()}
    assert columns[200].ownership == ",".join(":".join(map(str, x[:4])) for x in want[200])
    assert (columns[200].n_copied, columns[200].n_live, columns[400].ownership) == (1, 1, "")


def test_masked_texts(spark, docs):
    got = {r.doc_id: r.text for r in secret_scan.masked(owned(spark, 6)).collect()}
    assert got[99] == "mine: secret=[secret]" and got[3] == "before password=[example] after"
    masked = secret_scan.masked(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    for r in masked.collect():
        assert not base(r.text or "")
    clean = [r for r in fixtures.rows() if not secret_ish(r[1])]
    rest = [tuple(r) for r in masked.collect() if not (r.text and "[" in r.text and "secret]" in r.text)]
    assert sorted(map(repr, rest)) == sorted(map(repr, clean))


def secret_ish(text):
    return bool(text) and (bool(base(text)) or "ghp_" in text)


def test_empty_table(no_docs):
    assert secret_scan.find_secrets(no_docs).collect() == []
    assert secret_scan.masked(no_docs).collect() == []
