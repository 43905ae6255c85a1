import re
import time

import pytest
from helpers import EDGE, docs_of, edge_docs, no_docs

from postlytics.llm import pii
from postlytics.llm.common import table

KEY = "k"
TEXTS = [
    "Mr. John Smith met Mrs. Ann Smith. MR. JOHN SMITH left. Mr. Smith: +1 743-555-3824, +1 (743) 555-3824, 10.0.0.1",
    "Frau Müller, Bob.X1@Mail.Example.com bob.x1@mail.example.com eve@mail.example.com BOB.X1@MAIL.EXAMPLE.COM",
    "SSN 123-45-6789 card 4111 1111 1111 1111, 4111111111111111; no card: 1234567890123456; 300.1.1.1 v1.2.3",
    "password: 'aB3dE6gH9kLmNoPq' token = \"0123456789abcdef0123456789abcdef01234567\" г-жа Анна Иванова",
    "Nothing private here: 12 apples, 2024-01-02, a@b, version 2.0.",
]


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def words(t):
    return re.findall(r"[^\s,;']+", t)


def test_types_formats_and_coreference(spark):
    got = {r.doc_id: r for r in pii.replace_pii(docs_of(spark, TEXTS), KEY, count_col="n").collect()}
    assert got[4].text == TEXTS[4] and got[4].n == 0
    a = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. MR\. (\w+) (\w+) left\. Mr\. (\w+): "
                     r"\+(\d) (\d{3}-\d{3}-\d{4}), \+(\d) \((\d{3})\) (\d{3}-\d{4}), (\d+\.\d+\.\d+\.\d+)", got[0].text)
    assert a and a[2] == a[4] == a[7] != "Smith" and a[1] != a[3]
    assert (a[5], a[6]) == (a[1].upper(), a[2].upper())
    assert a[1] in pii.GIVEN["m_latin"] and a[3] in pii.GIVEN["f_latin"]
    assert a[9] == f"{a[11]}-{a[12]}" != "743-555-3824" and a[13] != "10.0.0.1"
    mails = [w for w in words(got[1].text) if "@" in w]
    assert mails[0] == mails[1] and mails[3] == mails[0].upper() and mails[2] != mails[0]
    assert mails[0].split("@")[1] == mails[2].split("@")[1]
    assert re.fullmatch(r"[a-z]{3}\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.com", mails[0])
    c = re.search(r"SSN (\d{3}-\d\d-\d{4}) card (\d{4} \d{4} \d{4} \d{4}), (\d{16}); no card: (\d{16}); (.*)", got[2].text)
    assert c[1] != "123-45-6789" and c[2].replace(" ", "") == c[3] != "4111111111111111"
    assert luhn(c[3]) % 10 == 0 and c[4] == "1234567890123456" and c[5] == "300.1.1.1 v1.2.3"
    d = re.fullmatch(r"password: '([a-zA-Z0-9]{16})' token = \"([0-9a-f]{40})\" г-жа (\w+) (\w+)", got[3].text)
    assert d and d[3] in pii.GIVEN["f_cyrillic"] and d[4].endswith("ова")


def test_distinct_and_keyed(spark):
    texts = [f"user{i} wrote u{i}@x{i % 7}.org from 10.{i % 200}.{i // 200}.7" for i in range(400)]
    texts += [f"{c}@a.io" for c in "abcdefghijklmnopqrst"]      # one-letter addresses collide
    out = [r.text for r in pii.replace_pii(docs_of(spark, texts), KEY).orderBy("doc_id").collect()]
    for pattern in (r"\S+@\S+", r"\d+\.\d+\.\d+\.\d+"):
        old = [m for t in texts for m in re.findall(pattern, t)]
        new = [m for t in out for m in re.findall(pattern, t)]
        assert len(old) == len(new) and len(set(new)) == len(set(old)) and not set(new) & set(old)
    other = [r.text for r in pii.replace_pii(docs_of(spark, texts), key="other").orderBy("doc_id").collect()]
    assert other != out
    assert out == [r.text for r in pii.replace_pii(docs_of(spark, texts), KEY).orderBy("doc_id").collect()]


def test_exhausted_format_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda kind, norm, attempt, key: pii.F.lit("same"))
    monkeypatch.setattr(pii, "ROUNDS", 2)
    with pytest.raises(ValueError):
        pii.replace_pii(docs_of(spark, ["10.0.0.1 10.0.0.2"]), KEY).collect()


def test_edges(spark):
    docs = edge_docs(spark)
    got = pii.replace_pii(docs, KEY)
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        map(str, (tuple(r) for r in docs.collect())))       # nothing private in them
    assert len(EDGE) == got.count()
    assert pii.replace_pii(no_docs(spark), KEY).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r for r in pii.op8_pii_surrogates(spark, "/root/testdata/sf0.01").collect()}
    assert set(old) == set(new)
    for pattern in (r"[^\s]+@[^\s]+", r"\+\d \(\d+\) \d+-\d+", r"\d+\.\d+\.\d+\.\d+", r"[0-9a-f]{40}"):
        seen = {}
        for d, t in old.items():
            a, b = re.findall(pattern, t), re.findall(pattern, new[d].text)
            assert len(a) == len(b)
            assert all(x != y and seen.setdefault(x, y) == y for x, y in zip(a, b))
        assert len(set(seen.values())) == len(seen) > 0
    assert all((new[d].n_replaced == 0) == (old[d] == new[d].text) for d in old)


@pytest.mark.parametrize("mail", ["-bob@x.com", "_bob@x.com", "...bob@x.com", "+bob@x.com", "%bob@x.com", "<bob@x.com>"])
def test_addresses_after_punctuation(spark, mail):
    got = pii.replace_pii(docs_of(spark, [f"Write to {mail} or bob@x.com now"]), KEY, count_col="n").first()
    new = re.findall(r"[a-z]+@[a-z]\.com", got.text)
    assert got.n == 2 and new[0] == new[1] != "bob@x.com"
    assert got.text == f"Write to {mail} or bob@x.com now".replace("bob@x.com", new[0])


def test_long_runs_of_address_characters_stay_linear(spark):
    text = "a-" * 100_000 + " " + "." * 100_000
    assert pii.replace_pii(docs_of(spark, [text + " 1"]), KEY).first().text == text + " 1"


PHONES = ["1-800-555-1234", "555 123 4567", "(017) 555 7713", "(555)123.4567", "1 (555) 123-4567",
          "1.555.123.4567", "...555-123-4567"]


def test_phone_formats(spark):
    got = pii.replace_pii(docs_of(spark, [f"call {p}, please" for p in PHONES] + ["pi 3.141 592 6535"]),
                          KEY, count_col="n").orderBy("doc_id").collect()
    for p, r in zip(PHONES, got):
        new = re.fullmatch("call (.*), please", r.text)[1]
        assert r.n == 1 and new != p and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", p)
    assert got[-1].n == 0


def test_full_names_without_title(spark):
    texts = ["John Smith is here. Mr. John Smith's car; \"John Smith\" left, JOHN SMITH too, John Smithson not.",
             "Frau Dr. Eva Groß, Prof. Lee Park and Dr. Park: Eva Groß, Lee Park. MR. PAT O'NEIL met Pat O'Neil",
             "John Smith alone is not looked for"]
    got = {r.doc_id: r for r in pii.replace_pii(docs_of(spark, texts), KEY, count_col="n").collect()}
    a = re.fullmatch(r"(\w+ \w+) is here\. Mr\. (\w+ \w+)'s car; \"(\w+ \w+)\" left, (\w+ \w+) too, John Smithson not\.",
                     got[0].text)
    assert a and a[1] == a[2] == a[3] == a[4].title() != "John Smith" and a[4].isupper() and got[0].n == 4
    b = re.fullmatch(r"Frau Dr\. (\w+ \w+), Prof\. (\w+ (\w+)) and Dr\. (\w+): (\w+ \w+), (\w+ \w+)\. "
                     r"MR\. (\w+ \w+) met (.*)", got[1].text)
    assert b and b[1] == b[5] and b[2] == b[6] and b[3] == b[4]
    assert b[1].split()[0] in pii.GIVEN["f_latin"] and b[2].split()[0] in pii.GIVEN["n_latin"]
    assert not {"Eva", "Groß", "Lee", "Park"} & set(re.findall(r"\w+", got[1].text))
    assert got[2].text == texts[2]


def test_long_entities_need_no_stack(spark):
    given = ["A" + "a" * 100_000, "A" + "-a" * 20_000, "O" + "'Ab" * 20_000]
    long = [f"Mr. {n} {n} came. {n} {n} left." for n in given]
    long += ["Mr. " * 20_000 + "Smith came", "Herr Dr. " * 5_000 + "Eva Groß came"]
    long += ["to bob@" + "ab." * 20_000 + "com now", "to bob@" + "a." * 40_000 + "7 now", "to bob@" + "a-" * 40_000 + ".com"]
    long += ["to " + "b" * 100_000 + "@x.com now", "token = " + "aB3" * 40_000]
    got = [r.text for r in pii.replace_pii(docs_of(spark, long), KEY).orderBy("doc_id").collect()]
    for old, new, n in zip(long, got, given):
        assert n not in new and new.startswith("Mr. ") and len(new.split()) == len(old.split())
    assert not any("Smith" in t or "Eva Groß" in t for t in got)
    assert got[5] != long[5] and got[5].endswith(".com now") and len(got[5]) == len(long[5])
    assert got[6:8] == long[6:8] and "b" * 100 not in got[8] and "aB3" * 9 not in got[9]


def test_many_names_in_a_text(spark):
    syllables = ["ba", "ko", "li", "mu", "re", "so", "ti", "va", "ne", "du", "pa", "fi", "gu", "ha"]
    names = [f"{a}{b}{c}".capitalize() + " " + f"{c}{b}{a}n".capitalize()
             for a in syllables for b in syllables for c in syllables]
    text = " ".join(f"Mr. {n} met {n}." for n in names)     # 2,744 names
    start = time.perf_counter()
    new = pii.replace_pii(docs_of(spark, [text]), KEY, count_col="n").first()
    assert time.perf_counter() - start < 60
    pairs = re.findall(r"Mr\. (\w+ \w+) met (\w+ \w+)\.", new.text)
    assert new.n == 2 * len(names) and len(pairs) == len(names) and all(a == b for a, b in pairs)
    assert not {a for a, _ in pairs} & set(names) and len(set(pairs)) == len(names)


def test_titles_and_hosts_in_context(spark):
    texts = ["Mr. Doctorow, Mr. Sir came, Mr. Sir Alec Guinness; x@ab.cd.e9 bob@x.com. Then bob@x.com.5",
             "a@b.co-op.org a@-b.com a@b..com a@b.c a@b-.com"]
    got = [r.text for r in pii.replace_pii(docs_of(spark, texts), KEY).orderBy("doc_id").collect()]
    assert not re.search("Doctorow|Alec|Guinness|bob@|ab.cd", got[0]) and "Mr. Sir came" not in got[0]
    assert re.search(r"\w@\w\w\.cd\.e9 (\w+@\w\.com)\. Then \1\.5$", got[0])
    assert re.fullmatch(r"\w@\w\.\w\w-\w\w\.org a@-b\.com a@b\.\.com a@b\.c a@b-\.com", got[1])
    assert got[1].split()[0] != "a@b.co-op.org"


def test_a_full_format_grows(spark, monkeypatch):
    monkeypatch.setattr(pii, "GROW", 2)
    texts = [f"call +1 2 {a}{b} {c}{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)]
    out = [r.text for r in pii.replace_pii(docs_of(spark, texts), KEY).orderBy("doc_id").collect()]
    assert len(set(out)) == len(texts) and not set(out) & set(texts)
    assert all(re.fullmatch(r"call \+1 \d \d\d \d{2,}", t) for t in out)


def test_hot_lists_are_salted(spark):
    docs = spark.createDataFrame([(i, "write to bob@x.com") for i in range(500)]
                                 + [(i, f"write to u{i}@x.com") for i in range(100)], "doc_id long, text string")
    got = pii.replace_pii(docs, KEY, count_col="n").collect()
    assert len(got) == 600 and all(r.n == 1 for r in got) and len({r.text for r in got}) == 101
