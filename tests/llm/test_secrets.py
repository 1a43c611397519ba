import hashlib
import re

from stepweave.llm import secrets

ODD = [
    (1, "password = 'abcdef1' and TOKEN:short token=longenough9"),
    (2, "AKIA" + "A1" * 8 + " AKIAB " + "AKIA" + "Z" * 15),
    (3, "é𝄞 0123456789abcdef0123456789 secret:  \"x.y/z+1\" deadbeef" + "0" * 16),
    (4, None),
    (5, ""),
    (6, "api_key=apikey=sevenchars Api_Key: 'abcdef"),
    (6, "api_key=apikey=sevenchars Api_Key: 'abcdef"),
    (None, "passwd=hunter22"),
    (7, "x " * 40_000 + "secret=" + "s" * 30),
    (8, "password=token=abcdef\nsecret\n=\nnone"),
    (9, "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890ab AIza" + "k" * 35),
]


def spans_by_hand(text):
    text = text or ""
    out = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_scan_equals_plain_regexes(docs_of):
    got = secrets.scan(docs_of(ODD)).collect()
    want = sorted((str(i), spans_by_hand(t)) for i, t in ODD)
    assert sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in got) == want
    assert sum(len(s) for _, s in want) > 12


def test_digest(docs_of):
    row = secrets.digest(secrets.scan(docs_of([ODD[0]]))).first()
    base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_by_hand(ODD[0][1]))
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (2, 0, 0)
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and row["spans"] == base


def test_empty_table(docs_of):
    assert secrets.digest(secrets.scan(docs_of([]))).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ((frozenset({"aki", "kia"}),),)
    assert secrets.trigram_query("[0-9a-f]{24,}") == ()
    assert secrets.trigram_query("ab(cd|ef)?") == ()
    # a longer alternative asks for no more than a shorter one that it contains
    assert secrets.trigram_query("abc(d|)x*") == ((frozenset({"abc"}),),)
    both = secrets.trigram_query("(?:abc|xyz)[0-9]+-end")
    assert both == ((frozenset({"abc"}), frozenset({"xyz"})), (frozenset({"-en", "end"}),))


def test_every_match_meets_its_query():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for _, text in ODD:
            for m in re.finditer(rule.pattern, text or "", re.ASCII):
                low = m.group().lower()
                assert all(any(all(g in low for g in alt) for alt in clause) for clause in query)
