import hashlib
import random
import re

from wattloom.llm import licenses, personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRICKY = [
    "a@b.c_d@e.f and x..y@d-e.fr, a@b@c.d @e.f g@h a@b.c.@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 1..2.3.4 99999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1 (555) 123-4567. +49 30 123 +1 2 +33(0)1-23-45-67-89) +1234567890123456 ++44 20 7946 0958",
    "é中😀 mail: ü.x@y.de; ip 10.0.0.1, token = \"908038b7daaf91e730d2f64001c52934d43d9336\" ssn: 123-45-6789 iban DE89370400440532013000",
    "7992739871" * 2, "4" * 3000, "+" * 500 + "1" * 20, "a@" * 900 + "b.c", "a.b." * 900 + "@x.yz", "- 4111111111111111 -", "4111111111111111\n5500 0000 0000 0004",
]


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns(spark, odd_docs, folder):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string")
    path = folder(documents=odd_docs.unionByName(more, allowMissingColumns=True))
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = sorted((str(d), *(sum(s[0] == k for s in base_spans(t or "")) for k in personal_data.BASE_KINDS), hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base_spans(t or "")).encode()).hexdigest()) for d, t in texts)
    rows = personal_data.query(spark, path).collect()
    assert sorted((str(r[0]), *r[1:6]) for r in rows) == want
    by_id = {r["doc_id"]: r["spans"] for r in rows}
    assert all(",".join(f"{a}:{b}:{c}" for a, b, c in base_spans(t or "")) in by_id[d] for d, t in texts if d is not None)
    assert "secret:" in by_id[1004] and by_id[3] == ""


def test_estimates_follow_agreeing_labelers():
    p = personal_data.estimate({("email", (1, 1, 1, 1)): 500, ("email", (1, 1, 0, 1)): 300, ("card", (-1, -1, -1, -1)): 400, ("card", (1, 1, 0, 1)): 100})
    assert p["email", (1, 1, 1, 1)] > 0.9 and p["card", (-1, -1, -1, -1)] < 0.1
    assert set(personal_data.train({})) == {0.0} and len(personal_data.train({})) == len(personal_data.inputs(("email", 0, 0, 0, 0, 0)))


def test_the_classifier_learns_looks_from_odds():
    rows = {("iban", size, digits, 0, 1, 1): (50, 48.0 if digits > 2 else 3.0) for size in range(2, 6) for digits in range(5)}
    w = personal_data.train(rows)
    odds = lambda *key: sum(a * b for a, b in zip(w, personal_data.inputs(("iban", *key)), strict=True))
    assert odds(7, 4, 0, 1, 1) > 0 > odds(7, 1, 0, 1, 1)  # a length that was not seen


def test_texts_of_very_many_matches(spark, folder):
    rng = random.Random(9)
    lines = [rng.choice([f"u{k}@mail.org", f"10.1.{k % 256}.7", f"ssn {100 + k % 800}-12-{1000 + k % 9000}", "plain words ü"]) for k in range(6000)]
    text = "\n".join(lines)
    row = personal_data.query(spark, folder(documents=spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    found = [x.split(":") for x in row["spans"].split(",")]
    assert [(k, int(a), int(b)) for k, a, b in found if k in personal_data.BASE_KINDS] == base_spans(text)
    assert [text[int(a) : int(b)] for k, a, b in found if k == "ssn"] == [x[4:] for x in lines if x.startswith("ssn")]
    again = personal_data.stage(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), "").first()["text"]
    assert "@" not in again and again.count("[SSN]") == sum(x.startswith("ssn") for x in lines) and again.count("\n") == text.count("\n")


def test_redaction_leaves_the_rest(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "write to a.b@c.org, or +1 (555) 123-4567!", 9), (2, "nothing here", 9), (3, None, 9)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in personal_data.stage(spark, docs, "").collect()}
    assert rows[1]["text"] == "write to [EMAIL], or [PHONE]!" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] == "nothing here" and rows[3]["text"] is None
    assert personal_data.stage(spark, no_docs, "").count() == 0 and personal_data.stage(spark, odd_docs, "").count() == odd_docs.count()


def test_long_secrets_are_whole(spark, folder):
    rng = random.Random(8)
    made = {k: "".join(rng.choices("ABCDEFabcdef0123456789+/", k=(40, 200, 201, 700)[k % 4])) for k in range(40)}
    docs = spark.createDataFrame([(k, f"here api_key = {x}, then more") for k, x in made.items()], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.query(spark, folder(documents=docs)).collect()}
    assert all(found[k] == f"secret:5:{15 + len(x)}" for k, x in made.items())
    assert {r["text"] for r in personal_data.stage(spark, docs, "").collect()} == {"here [SECRET], then more"}


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({b for _, b in hits}))


def test_license_base_equals_plain_search(spark, odd_docs, folder):
    texts = ["MIT License. mit-license, apache\nlicense; GNU General Public License", "licenses mit licensed mit license", "mit\x00license é mit license", "İ mit license K apache license", "permit license general public licence",
             "Released under the BSD 3-Clause license.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "It is in the public domain", "used under a strange license", "under the house",
             "This is not released under the Zlib License.", "SPDX-License-Identifier: MIT OR Apache-2.0", "See https://creativecommons.org/licenses/by-sa/4.0/", "GPL-2.0-only WITH Classpath-exception-2.0",
             "Redistributions of source code must retain the above copyright notice", "under the same terms as Perl itself", "We like bsd sockets and the mit campus"]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = licenses.query(spark, folder(documents=odd_docs.unionByName(more, allowMissingColumns=True))).collect()
    source = {str(r["doc_id"]): r["text"] for r in odd_docs.unionByName(more, allowMissingColumns=True).collect()}
    for r in rows:
        assert tuple(r[1:6]) == plain_scan(source[str(r["doc_id"])]), r
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert [labels[1000 + k] for k in range(5, 18)] == ["bsd", "cc-by-nc", "gpl", "public-domain", "other", "", "", "apache,mit", "cc-by-sa", "gpl-classpath-exception", "bsd", "perl", ""]


def test_rules_are_many_and_ordered():
    table = licenses.rules()
    by_hand = [r for r in table if r[0] in {label for _, label, _ in licenses.lines(licenses.NOTICES)} and r[3] == licenses.IDENTIFIED and r[1] != "spdx"]
    assert len(by_hand) >= 250 and len(table) > 600 and [r[3] for r in table[:5]] == [licenses.IDENTIFIED] * 5
    assert all(key == key.lower() and "|" not in key for _, key, _, _ in table)


def samples(parsed):
    """Texts that a parsed pattern matches: every branch, with and without what is optional."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "NOT_LITERAL":
            more = ["q"]
        elif name == "IN":
            first = next((a for o, a in arg if str(o) != "NEGATE"), None)
            more = ["q"] if str(arg[0][0]) == "NEGATE" else [chr(first[0] if isinstance(first, tuple) else first)]
            more = more if str(arg[0][0]) == "NEGATE" or len(arg) == 1 else [chr(a[0] if isinstance(a, tuple) else a) for _, a in arg]
        elif name == "SUBPATTERN":
            more = samples(arg[3])
        elif name == "BRANCH":
            more = [t for branch in arg[1] for t in samples(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            found = samples(inner)
            more = ([""] if least == 0 else [t * least for t in found]) + ([t * (least + 1) for t in found[:2]] if most > least else [])
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in more][:3000]
    return out


def test_every_sample_of_a_rule_holds_its_keyword_and_is_found(spark):
    import re._parser as parser

    notices = licenses.lines(licenses.NOTICES)
    assert len(notices) >= 250
    texts = []
    for key, *_, pattern in [*notices, *licenses.lines(licenses.DENIALS)]:
        found = samples(parser.parse(pattern))
        assert found and all(f" {key} ".strip() in f" {t} " for t in found), (key, pattern, next(t for t in found if key not in t))
    for key, label, pattern in notices:
        texts.append((label, min(samples(parser.parse(pattern)), key=len)))
    docs = spark.createDataFrame([(k, f"Zyx. {t.capitalize()}, qed") for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scanned(docs).collect()}
    missed = [(texts[k], got[k]) for k in got if got[k] == [""]]
    assert not missed, missed
    assert sum(texts[k][0] in got[k] for k in got) >= 0.85 * len(texts)  # some are parts of what a stronger or longer rule finds


def test_no_documents_to_scan(spark, no_docs, folder):
    at = folder(documents=no_docs)
    assert licenses.query(spark, at).count() == 0 and personal_data.query(spark, at).count() == 0


def test_rules_besides_notices_need_a_keyword(spark):
    """What is skipped for texts without KEYWORDS cannot match there; notices that need none of them are still found."""
    skipped = [r for r in licenses.rules() if r not in licenses.notices()]
    assert len(skipped) > 400 and len(licenses.notices()) > 150
    for _, key, pattern, _ in skipped:
        assert any(k in key for k in licenses.KEYWORDS[:4]) or "under " in pattern or "licen" in pattern
        if "|" in pattern and "licen" not in pattern.replace("licensed", "") and not any(k in key for k in licenses.KEYWORDS[:4]):
            assert licenses.UNDER in pattern and all(re.search(licenses.KEYWORDS[4], f"{w} under ") for w in licenses.UNDER[3:].split(") under")[0].split("|"))
    texts = ["used under mit", "Available under the Apache Software 2.0", "Dual Licensed under GPL", "all rights reserved", "used for good, not evil: The Software shall be used for Good, not Evil", "something unlike the rest"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(docs).collect()}
    assert got == {0: "mit", 1: "apache", 2: "dual-licensed,gpl", 3: "proprietary", 4: "json", 5: ""}
