import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are given, one after the other."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.-+ 0(4é\n_", max_size=40))
def test_spans_equal_the_given_patterns(text):
    assert sorted(pii.base_spans(text)) == plain(text)


def test_edges():
    assert pii.base_spans("") == []
    assert pii.listed(pii.base_spans("ünd a.b@c.d 4111 1111 1111 1111, 10.0.0.255")) == "email:4:11,card:12:31,ip:33:43"
    assert pii.base_spans("1.2.3.256, 4111 1111 1111 1112") == []
    assert pii.base_spans("a@b.c_d@e.f") == [(0, 0, 5), (5, 0, 11)]
    assert pii.base_spans("a" * 300_000 + "@") == []
    assert pii.base_spans("0" * 6000 + ".1.1.1") == [(0, 1, 6006)]


def test_query(spark, make_docs):
    near = [f"Word{i} other{i} Quillon writes to boss@firm.com from place{i} about thing{i} and much more" for i in range(6)]
    far = [f"plain words number{i} without anything to hide but other things" for i in range(30)]
    copies = ["Zebra copy always says hello zebrafish to dup@firm.com today and nothing else at all"] * 12
    texts = [*near, *far, *copies, None, "", "call +1 (743) 555-3824 now"]
    rows = pii.personal_data(make_docs(texts)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = pii.listed(plain(text or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[i]["n_email"] == base.count("email") and got[i]["n_phone"] == base.count("phone")
        assert {s for s in base.split(",") if s} <= set(got[i]["spans"].split(","))
    # Independent documents show that the name gives the address away; copies of one document don't.
    assert [near[0][a:z] for k, a, z in pii.parse(got[0]["spans"]) if k == "term"] == ["Quillon", "writes", "from", "about"] or "Quillon" in [near[0][a:z] for k, a, z in pii.parse(got[0]["spans"]) if k == "term"]
    assert all(got[i]["n_term"] == 0 for i in range(6, len(texts)))
    clean = pii.sanitised(near[0], got[0]["spans"], got[0]["removed"])
    assert "Quillon" not in clean and "[EMAIL]" in clean and "Word0" in clean


def test_shares_by_brute_force(spark, make_docs):
    texts = [f"amber{i % 2} speaks to boss@firm.com in town{i}" for i in range(8)] + [f"amber{i % 2} alone number{i}" for i in range(3)] + ["nothing"] * 5
    docs = make_docs(texts)
    rule = pii.Disclosure()
    got = {(r["term"]): r["share"] for r in pii.disclosures(docs, pii.scan(docs, rule), rule).collect()}
    n, with_value = len(texts), 8
    for term in ("amber0", "amber1", "speaks"):
        holders = [t for t in texts if term in t.split()]
        both = [t for t in holders if "boss@" in t]
        share = math.log2(len(both) / len(holders) * n / with_value) / math.log2(n / with_value)
        assert (term in got) == (share >= rule.generalise)
        if term in got:
            assert got[term] == pytest.approx(share)


def test_sanitise_and_empty(spark, make_docs):
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(make_docs(["mail a@b.cd now", None])).collect()}
    assert out == {0: "mail [EMAIL] now", 1: None}
    assert pii.personal_data(make_docs([])).count() == 0


def test_low_counts_and_copies_are_judged_by_share(spark, make_docs):
    once = ["Quillon lives with lone@firm.com near the common river"]
    seen = [f"Zephyr{' x' * 30} lead{i} Marlow signs boss@firm.com beside the common river part{i} page{i}" for i in range(3)]
    copies = [seen[0]] * 20
    far = [f"the common river number{i} has place{i} and thing{i} to see" for i in range(300)]
    texts = [*once, *seen, *copies, *far]
    got = {r["doc_id"]: r for r in pii.personal_data(make_docs(texts)).collect()}
    terms = lambda i, column: {texts[i][a:z] for k, a, z in pii.parse(got[i][column]) if k == "term"}
    assert "Quillon" in terms(0, "removed") and not {"the", "common", "river"} & terms(0, "spans")
    for i in (1, 2, 3, 4, 23):
        assert "Marlow" in terms(i, "removed") and not {"the", "common", "river"} & terms(i, "spans")
    assert all(got[i]["n_term"] == 0 for i in range(24, len(texts)))


def test_counts_are_of_witnesses(spark, make_docs):
    texts = [f"Marlow{i % 4} signs at boss@firm.com with page{i} and part{i}" for i in range(8)] * 3
    texts += [f"Marlow{i} stands alone as number{i} in row{i}" for i in range(3)] * 2 + [f"other words number{i} here row{i}" for i in range(200)]
    docs, rule = make_docs(texts), pii.Disclosure()
    codes = pii.WordCodes()
    which = {t: pii.witness(t, codes) for t in texts}
    count = lambda *words: len({which[t] for t in texts if all(w in t.split() for w in words)})
    got = {r["term"]: r["share"] for r in pii.disclosures(docs, pii.scan(docs, rule), rule).collect()}
    n_value, total = count("boss@firm.com"), len(set(which.values()))
    for term in ("Marlow0", "Marlow1", "Marlow3", "signs"):
        both, n = count(term, "boss@firm.com"), count(term)
        share = math.log2(both / n * total / n_value) / math.log2(total / n_value)
        accident = math.comb(n, both) * math.comb(n_value, both) / math.comb(total, both)
        assert (term.lower() in got) == (share >= rule.generalise and (both >= rule.support or accident <= rule.chance)), term
        if term.lower() in got:
            assert got[term.lower()] == pytest.approx(share)


def test_terms_far_from_the_value(spark, make_docs):
    texts = [f"lead{i} Marlow signs boss@firm.com beside page{i}" for i in range(3)]
    gap = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    texts += [f"Marlow starts {gap(i)} boss@firm.com and ends {gap(i)} signed Marlow" for i in range(3, 6)]
    texts += [f"other words number{i} here row{i}" for i in range(150)]
    docs, rule = make_docs(texts), pii.Disclosure()
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    for i in range(6):
        spans = [(a, z) for k, a, z in pii.parse(got[i]["removed"]) if texts[i][a:z] == "Marlow"]
        assert spans == [m.span() for m in re.finditer("Marlow", texts[i])]
    assert all(got[i]["n_term"] == 0 for i in range(6, len(texts)))
    # Documents with the two far apart are in the joint count, so that the term gives everything away.
    shares = {r["term"]: r["share"] for r in pii.disclosures(docs, pii.scan(docs, rule), rule).collect()}
    assert shares["marlow"] == pytest.approx(1.0)


def plain_columns(texts, rule=pii.Disclosure()):
    """spans, n_term, removed of each text, by counting over all texts for each candidate."""
    codes, base = pii.WordCodes(), [plain(t or "") for t in texts]
    which = [pii.witness(t or "", codes) for t in texts]
    values = [{(k, t[a:z].lower()) for a, k, z in own} for t, own in zip((t or "" for t in texts), base)]
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t or "")] for t in texts]
    free = lambda i: [w for w in words[i] if len(w[2]) >= rule.min_chars and not any(a <= w[0] < z for a, _, z in base[i])]
    terms = [{w[2] for w in free(i)} for i in range(len(texts))]
    near = set()
    for i, t in enumerate(texts):
        for a, k, z in base[i]:
            before = [w[2] for w in words[i] if w[0] < a][-rule.window :]
            inside = [w[2] for w in words[i] if a <= w[0] < z]
            after = [w[2] for w in words[i] if w[0] >= z][: rule.window]
            near |= {((k, t[a:z].lower()), w) for w in {*before, *inside, *after} & terms[i]}
    total, verdicts = len(set(which)), {}
    for value, term in near:
        n_value = len({w for w, v in zip(which, values) if value in v})
        both = len({w for w, v, t in zip(which, values, terms) if value in v and term in t})
        n = max(both, len({w for w, own in zip(which, words) if term in {x[2] for x in own}}))
        information = math.log2(total / n_value)
        share = math.log2(both / n * total / n_value) / information if information > 0 else 0
        accident = math.comb(n, both) * math.comb(n_value, both) / math.comb(total, both)
        if share >= rule.generalise and (both >= rule.support or accident <= rule.chance):
            verdicts[value, term] = "remove" if share >= rule.remove else "generalise"
    out = []
    for i in range(len(texts)):
        own = [(a, 4, z, max(verdicts[v, w] for v in values[i] if (v, w) in verdicts)) for a, z, w in free(i) if any((v, w) in verdicts for v in values[i])]
        out.append((pii.listed(base[i] + [x[:3] for x in own]), len(own), pii.listed([x[:3] for x in own if x[3] == "remove"])))
    return out


def planted(rng):
    """Ten people, each with an own name and address in some documents; common words around them."""
    common = [f"word{i}" for i in range(60)]
    people = [(f"Name{i}", f"p{i}@firm{i % 4}.com" if i % 2 else f"+1 (743) 555-38{i:02}") for i in range(10)]
    texts = []
    for _ in range(220):
        body = rng.choices(common, k=rng.randrange(4, 50))
        if rng.random() < 0.3:
            name, address = rng.choice(people)
            body.insert(rng.randrange(len(body)), address)
            body[rng.randrange(len(body)) : 0] = [name] * (rng.random() < 0.9)
        body += [f"rare{rng.randrange(300)}"]
        texts.append(" ".join(body))
    return texts + texts[:30] + [None, "", " "], people


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result_equals_brute_force(spark, make_docs, seed):
    texts, people = planted(random.Random(seed))
    want = plain_columns(texts)
    ids = [i if i < 200 else None if i < 210 else i // 2 for i in range(len(texts))]  # null ids and repeated ones
    docs = make_docs(texts, ids=ids).withColumnRenamed("size", "n_term").withColumnRenamed("fp", "_spans")
    rows = pii.personal_data(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["spans"], r["n_term"], r["removed"]) for r in rows), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)
    # The planted names are terms wherever they stand with their person's address.
    held = [(name, i) for i, t in enumerate(texts) for name, address in people if t and address in t and name in t.split()]
    caught = sum(any(texts[i][a:z] == name for k, a, z in pii.parse(want[i][0]) if k == "term") for name, i in held)
    assert len(held) > 30 and caught >= 0.9 * len(held)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = {r["n_term"]: r for r in clean.collect()}
    assert all(got[i]["text"] == (t and pii.sanitised(t, want[i][0], want[i][2])) and got[i]["doc_id"] == ids[i] and got[i]["_spans"] == "x" for i, t in enumerate(texts))


def test_repeated_ids_leak_nothing(spark, make_docs):
    docs = make_docs(["write today to xy@zz.org ok", "mail a@b.cd now", "none here"], ids=[1, 1, 1])
    assert sorted(r["text"] for r in pii.sanitise(docs).collect()) == ["mail [EMAIL] now", "none here", "write today to [EMAIL] ok"]


def test_very_long_text(spark, make_docs):
    text = "word " * 200_000 + "a@b.cd " + "x" * 300_000
    (row,) = pii.personal_data(make_docs([text])).collect()
    assert row["n_email"] == row["n_personal"] == 1 and row["spans"].startswith("email:1000000:1000006")
