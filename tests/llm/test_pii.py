"""Personal data against plain patterns, and disclosure against counts over all pairs."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import frame, prose, rows
from noticeflow.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x if x < 10 else x - 9
    return total % 10 == 0


def plain_base(text):
    out = []
    for at, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), at, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("ab@@..+-- 0011223345()%é\n", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_patterns_on_what_people_write():
    for text in ("a.b@c.d.e@f.gg, x@y, @a.b.c", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111-4111111111111111", "4111111111111111 and 4539-5787-6362-1486", "+1 (017) 555-7713 +12 3 +1-2-3-4-5-6-7-8-9-0", "x" * 99 + "@" + "a-." * 40 + "b"):
        assert pii.base_spans(text) == plain_base(text)
    assert len(pii.base_spans("4111111111111111, a@b.co, 10.0.0.1, +1 (017) 555-7713")) == 4


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "+1" + " " * 300_000, "1 " * 150_000):
        pii.base_spans(text)


def corpus():
    """Fixture rows, a person named with one address in several documents, and the same words without it."""
    rng = random.Random(8)
    some = [(r[0], r[1]) for r in rows()]
    for i in range(6):
        some.append((200 + i, f"{prose(10)} Zebulonia of flat 7421 wrote: mail zeb{'' if i else 'X'}@mail.example.com or ring; Zebulonia. {prose(10)}"))
    some += [(300 + i, f"{prose(12)} zebras of the flat 8421 ring {prose(5)}") for i in range(30)]
    some += [(400 + i, f"{prose(3)} call +1 (017) 555-{rng.randrange(1000, 9999)} {prose(3)}") for i in range(5)]
    return some


def plain_find(docs, near=pii.NEAR):
    """(doc_id, counts, base, spans as listed), with counts over all pairs."""
    n = len(docs)
    kinds = list(PLAIN)
    general = lambda t: re.sub("[0-9]", "#", t) if re.search("[0-9]", t) else t[:3] + "*" if len(t) > 4 else None
    seen = Counter()
    for _, text in docs:
        words = {w.lower() for w in WORD.findall(text or "")}
        seen.update(words | ({general(w) for w in words} - {None}))
    entities, pairs, by_doc = Counter(), Counter(), []
    for _, text in docs:
        text = text or ""
        base = plain_base(text)
        words = [m for m in WORD.finditer(text) if all(m.end() <= a or m.start() >= b for a, _, b in base)]
        told = set()
        for a, k, b in base:
            value = text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])
            before, after = [m for m in words if m.end() <= a][-near:], [m for m in words if m.start() >= b][:near]
            told |= {(f"{kinds[k]}:{value}", m.group().lower()) for m in before + after} | {(f"{kinds[k]}:{value}", None)}
        entities.update(e for e, t in told if t is None)
        pairs.update({(e, t) for e, t in told if t} | {(e, general(t)) for e, t in told if t and general(t)})
        by_doc.append((base, words, told))
    share = lambda e, t: math.log(n * pairs[e, t] / (entities[e] * seen[t])) / math.log(n / entities[e])
    bad = {(e, t) for e, t in pairs if pairs[e, t] >= 3 and "#" not in t and "*" not in t and share(e, t) >= pii.SHARE}
    out = []
    for (i, text), (base, words, told) in zip(docs, by_doc):
        gone = {t for e, t in told if (e, t) in bad}
        spans = sorted(base + [(m.start(), 4, m.end()) for m in words if m.group().lower() in gone])
        say = lambda x: ",".join(f"{[*kinds, 'term'][k]}:{a}:{b}" for a, k, b in x)
        out.append((i, *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
    return sorted(out, key=repr)


def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in docs], frame(spark, []).schema).repartition(5)


def test_find(spark):
    docs = corpus()
    found = sorted((tuple(r) for r in pii.find(spark, table(spark, docs)).collect()), key=repr)
    assert found == plain_find(docs)
    assert "term:" in "".join(r[-1] for r in found)
    clean = {i for i, t in docs if not plain_base(t or "")}
    assert all(not r[-1] for r in found if r[0] in clean)


def test_terms_of_the_whole_document_are_held_against_an_entity(spark):
    """Also those far from it, before and after; and one that is near it in some documents goes where it is far, too."""
    far = " ".join(f"w{i % 7}" for i in range(60))
    docs = [(i, f"Quillfeather began. {far} mail qf@mail.example.com {far} Marrowgate {i}") for i in range(4)]
    docs += [(4, f"Marrowgate, qf@mail.example.com. {far} Quillfeather"), (5, f"{far} Quillfeld and Marrowbone")]
    docs += [(10 + i, f"{far} of {i}") for i in range(30)]
    found = sorted((tuple(r) for r in pii.find(spark, table(spark, docs)).collect()), key=repr)
    assert found == plain_find(docs, near=10**9)
    texts = {r.doc_id: r.text for r in pii.sanitise(spark, table(spark, docs)).collect()}
    assert all("Quillfeather" not in texts[i] and "Marrowgate" not in texts[i] and texts[i].count("w3") == docs[i][1].count("w3") for i in range(5))
    assert texts[5] == docs[5][1]


@pytest.mark.parametrize("seed", range(3))
def test_counts_that_are_not_made_would_not_disclose(spark, seed):
    """Entities and terms of any frequency, several entities a document, against counts of all pairs."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("al", "ber", "corv", "dun42") for b in ("", "ing", "enth", "7") for c in ("", "a", "ory")]
    people = [f"p{i}@mail.example.com" for i in range(5)]
    docs = []
    for i in range(80):
        who = [p for k, p in enumerate(people) if rng.random() < (0.04, 0.08, 0.15, 0.4, 0.9)[k]]
        told = [words[(7 * people.index(p) + j) % len(words)] for p in who for j in range(5) if rng.random() < 0.9]
        text = told + [words[min(rng.randrange(48), rng.randrange(48))] for _ in range(rng.randrange(4))] + who
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
    found = sorted((tuple(r) for r in pii.find(spark, table(spark, docs)).collect()), key=repr)
    assert found == plain_find(docs, near=10**9) and "term:" in "".join(r[-1] for r in found)


def test_sanitised_text(spark):
    docs = corpus()
    texts = {r.doc_id: r.text for r in pii.sanitise(spark, table(spark, docs)).collect() if r.doc_id is not None and r.doc_id >= 200}
    for i in range(201, 206):  # the name goes: its beginning gives it away no less than five documents do not
        assert "<email>" in texts[i] and "zeb@" not in texts[i] and "Zebulonia" not in texts[i] and "7421" not in texts[i]
        assert "zeb*" in texts[i] and "####" in texts[i] and " ring; " in texts[i]
    assert all("zebras of the flat 8421" in texts[i] for i in range(300, 330))
    assert all("<phone>" in texts[i] for i in range(400, 405))


def test_nulls_and_no_rows(spark):
    assert pii.find(spark, frame(spark, [])).collect() == []
    row = pii.sanitise(spark, table(spark, [(None, None)])).first()
    assert row.doc_id is None and row.text is None and row.spans == "" and row.base_sha256 == hashlib.sha256(b"").hexdigest()
