"""Operators of problems 2 to 8 on small tables: brute force, round trips, and the cases that must not break them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkquarry.llm import encodings, leaks, lookalikes, packing, personal, scans, stuffed, units
from inkquarry.llm.boost import Boosted
from inkquarry.llm.fmindex import FMIndex
from inkquarry.llm.queries import R

from ..oracle import DATA, compare, connect

UNITS = "src string, doc_id bigint, page int, line int, name string, text string"
WORDS = "doc_id bigint, page int, ord int, text string, rect array<double>, line int, name string"
DOCS = "doc_id bigint, text string, lang string, extra string, word string"


def rows(df, *by):
    return sorted((tuple(r) for r in (df.select(*by) if by else df).collect()), key=str)


def lines(spark, texts):
    return spark.createDataFrame([("glyphs", 1, 1, i, "", t) for i, t in enumerate(texts)], UNITS)


# problem 2


PLAIN = ["the stone bridge was copied", "the stone bridge was so old", "la canción del río", "новый журнал у реки", "το παλιό γεφύρι", "we cope with the bridge"] * 3


def test_lookalikes(spark):
    odd = {
        "the stоne bridge": "the stone bridge", "th​e stone": "the stone", "stone bridge": "stone bridge", "ｔｈｅ bridge": "the bridge", "la canción": "la canción", "новый журнaл": "новый журнал", "брiдgе unknоwn": None,
        "was ѕо old": "was so old", "𝐭𝐡𝐞 bridge": "the bridge", "ﬁne bridge": "fine bridge", "the bri­dge": "the bridge",
    }
    fine = ["area 20 m² and ½", "“the” – bridge", "новый журнал", "το παλιό", "«Верх» reads the bridge", "mail someone.long@example.org αύριο. Ο φύλακας", "", None, "plain"]
    texts = PLAIN + list(odd) + fine
    got = {r["text"]: r["consistent"] for r in lookalikes.consistent(lines(spark, texts)).collect()}
    for t, want in odd.items():
        assert t in got and (want is None or got[t] == want), (t, got.get(t))
    assert not set(fine) & set(got)
    assert lookalikes.consistent(lines(spark, ["x"]).limit(0)).count() == 0


def test_trie_costs():
    t = lookalikes.Trie()
    for w in ("stone", "store", "tone"):
        t.add(w, 1)
    assert [x[1] for x in t.reach("stоne")] == ["stone"] and t.reach("st​one")[0][:2] == (0.0, "stone")
    assert {x[1] for x in t.reach("stone", limit=1.0)} == {"stone", "store", "tone"}


def test_affordable_edits():
    t = lookalikes.Trie()
    for w in ("paypol", "café", "fine"):
        t.add(w, 3)
    assert t.reach("раурol") == [(0.0, "paypol", 3)] and t.reach("cafe\u0301") == [(0.0, "café", 3)] and t.reach("ﬁne") == [(0.0, "fine", 3)]
    # a letter that nearly looks alike costs something, two of them or any other letter too much
    assert t.reach("pаypoI") == [(0.4, "paypol", 3)] and t.reach("pаypOI") == [] and t.reach("paypal") == [] and t.reach("cafe") == []
    assert lookalikes.shape("pаypOI") == lookalikes.shape("paypol") and lookalikes.shape("ca\u200bfe\u0301") == lookalikes.shape("café")


def test_tries_come_before_the_table(spark):
    # what is attested decides the spelling; what is not is read by table
    texts = ["new music at paypol"] * 3 + ["pаypoI is new", "ｐａｙｐｏｌ at", "ｑｕｕｘ at", "cafe\u0301 at", "a\u00a0b"]
    got = {r["text"]: r["consistent"] for r in lookalikes.consistent(lines(spark, texts)).collect()}
    assert got == {"pаypoI is new": "paypol is new", "ｐａｙｐｏｌ at": "paypol at", "ｑｕｕｘ at": "quux at", "cafe\u0301 at": "café at", "a\u00a0b": "a b"}


# problem 4


CLEAN = ["Der Müller prüfte die Brücke", "la canción de la niña", "o irmão comprou a canção à noite", "мальчик нашёл новый журнал", "η γειτόνισσα ξέχασε τον χάρτη", "the “old” bridge – naïve café", "Preis 20 € und 30 £"] * 5


@pytest.mark.parametrize("a, b", [("utf_8", "cp1252"), ("utf_8", "cp1251"), ("utf_8", "cp437"), ("utf_8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp1251")])
def test_encodings_round_trip(spark, a, b):
    words = ["Müller", "prüfte", "Brücke", "canción", "niña", "irmão"]
    bad = []
    for w in words:
        try:
            bad.append(f"x {w.encode(a).decode(b)} y")
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
    got = {r["text"]: r["restored"] for r in encodings.restored(lines(spark, CLEAN + bad)).collect()}
    assert set(got) == set(bad)
    assert all(v.split()[1] in words for v in got.values())


def test_encodings_found(spark):
    bad = ["twice MÃƒÂ¼ller", "â€œoldâ€\x9d bridge", "lost M�ller", "a ca??o here", "irm?o", "ÒoldÓ bridge", "Ј344 paid", "à".encode().decode("latin_1") + " x", "мальчик".encode("cp1251").decode("cp1252"), "журнал".encode("koi8_r").decode("cp1251")]
    fine = CLEAN + ["LE CHÂTEAU DE L'ÎLE", "really? yes", "20 m²", "½ of it", "€ 20", "• item", "N.SАLТМARSH@MAIL.TEST", "", None, "marked К22"]
    got = {r["line"] for r in encodings.found(lines(spark, bad + fine)).collect()}
    assert got == set(range(len(bad)))
    assert encodings.found(lines(spark, ["x"]).limit(0)).count() == 0


def test_encodings_verify_the_original(spark):
    # found without any clean word that has the letters, but given back only where the corpus attests them
    bad = "ein " + "Müller".encode().decode("latin_1") + " da"
    alone, attested = ({r["text"]: r["restored"] for r in encodings.restored(lines(spark, [bad, *more])).collect()} for more in ((), ("über die Brücke",)))
    assert encodings.found(lines(spark, [bad])).count() == 1 and alone == {} and attested == {bad: "ein Müller da"}


def test_encodings_of_a_lone_letter(spark):
    # a letter of another script stands for one of the text's own
    text = ["Ο ναυτικός βρήκε τη βάρκα", "Ο ψαράς άνοιξε το παλιό γεφύρι"] * 8
    got = {r["text"]: r["restored"] for r in encodings.restored(lines(spark, [*text, "Ï ναυτικός βρήκε τη βάρκα", "it cost 5 € and ½ of it", "naïve Ï"])).collect()}
    assert got == {"Ï ναυτικός βρήκε τη βάρκα": "Ο ναυτικός βρήκε τη βάρκα"}


def test_one_garbled_file_is_no_usual_spelling(spark):
    # half of all lines are of one file, garbled into words that look clean
    clean = ["инженер купил новый журнал за мостом", "мельник открыл старый зонтик у реки"]
    bad = [t.encode("cp1251").decode("koi8_r") for t in clean]
    data = [("glyphs", 1, 1, i, "", bad[i % 2]) for i in range(400)] + [("glyphs", 2 + i // 4, 1, i % 4, "", clean[i % 2]) for i in range(400)]
    got = encodings.found(spark.createDataFrame(data, UNITS))
    assert {r["doc_id"] for r in got.collect()} == {1} and got.count() == 400


# problem 3


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    x[:, 4] = rng.random(600) < 0.01
    held = np.arange(600) % 3 == 0
    m = Boosted().fit(x, y, held)
    assert ((m.probability(x[held]) > 0.5) == y[held]).mean() > 0.9
    assert (m.probability(x) == Boosted().fit(x, y, held).probability(x)).all()


def test_read_through():
    s, at = personal.read_through("а​b@х.org  ок")
    assert s == "ab@x.org  ок" and len(at) == len(s) and at[1] == 2


def test_personal_over_page_ends_in_any_script(spark):
    names = ["Łukasz Żak", "Šimon Novák", "Иван Петров", "Ελένη Δούκα", "Petra Navarell", "Jory Marwick"]
    fields = [(i, "f.name[0]", [names[i % 6]]) for i in range(60)] + [(99, "f.name[0]", ["山田 太郎"]), (98, "f.name[0]", ["see file"])]
    probe = ["Reply by Petra Navarell or Łukasz", "Żak soon.", "Signed by Mr Šimon Novák here.", "Это пишет Иван Петров нам.", "Witnessed by Dr. Jory"]
    after = ["Marwick on the first day.", "write to jory", "@mail.example now"]
    data = [("glyphs", 9, 1, i, "", t) for i, t in enumerate(probe)] + [("glyphs", 9, 2, i, "", t) for i, t in enumerate(after)]
    lu = spark.createDataFrame(data, UNITS)
    fu = units.field_units(spark.createDataFrame(fields, "doc_id bigint, name string, value array<string>"), number_elements=True)
    items = personal.detect(lu, fu)
    assert items.where("src = 'fields' and doc_id = 99").count() == 1 and items.where("src = 'fields' and doc_id = 98").count() == 0
    red = {(r["page"], r["line"]): r["redacted"] for r in personal.redacted(lu.unionByName(fu), items).where("src = 'glyphs'").collect()}
    assert red[1, 0] == "Reply by [PERSON_NAME] or [PERSON_NAME]" and red[1, 1] == " soon." and red[1, 2] == "Signed by [PERSON_NAME] here." and red[1, 3] == "Это пишет [PERSON_NAME] нам."
    # the item counts on the page where it begins, and its end on the next page goes too
    assert red[1, 4] == "Witnessed by [PERSON_NAME]" and red[2, 0] == " on the first day."
    assert {(r["page"], r["parts"][0]["line"]) for r in items.where("src = 'glyphs'").collect()} == {(1, 0), (1, 2), (1, 3), (1, 4)} | {(r["page"], r["parts"][0]["line"]) for r in items.where("kind = 'email'").collect()}


def test_personal_on_a_few_rows(spark):
    # every kind has a model without any labelled row of the table
    lu = spark.createDataFrame([("glyphs", 1, 1, 0, "", "Call +44 20 7946 0321 or write to ann@mail.example."), ("glyphs", 1, 1, 1, "", "Serial 4471 220 998 is on it.")], UNITS)
    none = units.field_units(spark.createDataFrame([], "doc_id bigint, name string, value array<string>"), number_elements=True)
    assert {(r["kind"], r["parts"][0]["line"]) for r in personal.detect(lu, none).collect()} == {("phone", 0), ("email", 0)}
    assert personal.detect(lu.limit(0), none).count() == 0


def test_threshold_by_kind():
    m = Boosted()
    m._choose(np.array([0.1, 0.2, 0.7, 0.9]), np.array([0.0, 0, 1, 1]))
    assert m.threshold == 0.5
    m._choose(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0.0, 0, 1, 1]))
    assert 0.2 < m.threshold <= 0.3
    m._choose(np.array([0.6, 0.6, 0.8, 0.8]), np.array([0.0, 0, 1, 1]))
    assert 0.6 < m.threshold <= 0.8


def test_personal(spark):
    rng = random.Random(1)
    first, last = ["Petra", "Ruben", "Odile", "Jory", "Sabine"], ["Navarell", "Marwick", "Trevane", "Ormesher", "Fennick"]
    name = lambda: f"{rng.choice(first)} {rng.choice(last)}"
    phone = lambda: f"{rng.randrange(200, 999)}-555-0{rng.randrange(100, 199)}"
    text, fields = [], []
    for i in range(120):
        fields += [(i, "f.name[0]", [name()]), (i, "f.tel[0]", [phone()]), (i, "f.mail[0]", [f"a{i}@mail.test"]), (i, "f.street[0]", [f"{i + 1} Mill Street, Dunmere"]), (i, "f.document[0]", [f"SSN {rng.randrange(100, 600)} 45 {rng.randrange(1000, 9999)}"]), (i, "f.item[0]", [f"{i}-20"]), (i, "f.notes[0]", [f"Walk along Mill Street. Serial {i + 100} 45 12345 came. The committee met"])]
        text += [f"Ask {name()} or ring {phone()}.", f"Serial {rng.randrange(100, 999)} {rng.randrange(10, 99)} 12345 belongs here."]
    probe = ["The box went to 12 Mill", "Street, Dunmere and Petra", "Navarell wrote to x.y [at] mail", "[dot] test about it.", "", "Nothing to see here."]
    data = [("glyphs", 7, i // 20, i % 20, "", t) for i, t in enumerate(text)] + [("glyphs", 9, 1, i, "", t) for i, t in enumerate(probe)]
    lu = spark.createDataFrame(data, UNITS)
    fu = units.field_units(spark.createDataFrame([*fields, *fields[:9], (1, "f.none[0]", None), (1, "f.nul[0]", [None, ""])], "doc_id bigint, name string, value array<string>"), number_elements=True)
    items = personal.detect(lu, fu)
    got = {(r["parts"][0]["line"], r["kind"]) for r in items.where("doc_id = 9 and src = 'glyphs'").collect()}
    assert got == {(0, "address"), (1, "person_name"), (2, "email")}
    red = {r["line"]: r["redacted"] for r in personal.redacted(lu.unionByName(fu), items).where("doc_id = 9 and src = 'glyphs'").collect()}
    assert red[0] == "The box went to [ADDRESS]" and red[1] == " and [PERSON_NAME]" and red[2] == " wrote to [EMAIL]" and red[3] == " about it."
    assert all(0 < m.threshold < 1 for m in personal.fit(personal.with_names(personal.spans(personal.texts(lu, fu)))).values())
    notes = items.where("name = 'f.notes[0]'").count()
    assert notes == 0 and items.where("name = 'f.tel[0]'").count() == 120 and items.where("name = 'f.document[0]' and kind = 'id_number'").count() == 120


# problem 5


def page(doc, number, body, header=None, footer=None):
    """Words of a page: header at the top, body lines below, footer at the bottom."""
    out, k = [], 0
    for i, (y, t) in enumerate(([(40.0, header)] if header else []) + [(66.0 + 14 * j, b) for j, b in enumerate(body)] + ([(790.0, footer)] if footer else [])):
        for w in t.split(" "):
            out.append((doc, number, k, w, [60.0 + 10 * k, y, 66.0 + 10 * k, y + 10], i, "clash"))
            k += 1
    return out


def test_scans(spark):
    body = ["the stone bridge was measured before the", "winter began and the harbour was counted", "because the weather had turned again"]
    data = []
    for n in range(1, 31):
        data += page(1, n, body, "REPORT OF THE SURVEY" + (f" {n + 10}" if n % 2 else ""), f"- {n} -" if n % 2 == 0 else None)
    odd = ["tbe stone brid-", "ge was mea sured and thestone was stonc", "both short- and long be-"]
    data += page(2, 1, [*body, *odd], "xvii") + page(2, 2, ["fore the winter", *body], "xviii REPORT OF THE SURVEY")
    data += page(2, 2, ["fore the winter", *body], "xviii REPORT OF THE SURVEY") + [(3, 1, 1, None, None, 0, "x"), (3, 1, 2, "", None, None, "x"), (None, 1, 1, "x", None, 0, "x")]
    w = spark.createDataFrame(data, WORDS).repartition(3)
    text = {(r["doc_id"], r["page"], r["ord"]): r["text"] for r in w.collect()}
    got = [(r["kind"], text[r["doc_id"], r["page"], r["ord"]]) for r in scans.found(w).where("doc_id = 2").collect()]
    assert sorted(x for x in got if x[0] == "page_number") == [("page_number", "xvii"), ("page_number", "xviii")]
    assert sorted(t for k, t in got if k == "running") == ["OF", "REPORT", "SURVEY", "THE"]
    assert sorted(t for k, t in got if k == "hyphen") == ["be-", "brid-"]
    assert {"tbe", "stonc", "thestone", "mea"} <= {t for k, t in got if k == "misread"}
    para = " ".join(r["text"] for r in scans.paragraphs(w).where("doc_id = 2").orderBy("page", "line").collect())
    assert "the stone bridge was measured and the stone was stone" in para and "before the winter" in para and "REPORT" not in para
    assert scans.found(spark.createDataFrame([], WORDS)).count() == 0


def test_scans_mean_the_same_at_ten_times_the_size(spark):
    body = ["the stone bridge was measured before the", "winter began and the harbour was counted", "in 1904 because the weather had turned again", "and 37 boats of 1881 were bought for 250"]
    odd = ["tbe stone brid-", "ge was mea sured and thestone was stonc", "in 19O4 the harbour was countcd", "in 1904 and 37 boats of 188l were bought"]
    found = []
    for times in (1, 10):
        data = [x for k in range(times) for n in range(1, 41) for x in page(10 * k + 1, n, body)] + [x for k in range(times) for x in page(10 * k + 2, 1, [*body, *odd])]
        w = spark.createDataFrame(data, WORDS).repartition(4)
        text = {(r["doc_id"], r["page"], r["ord"]): r["text"] for r in w.collect()}
        found.append(sorted((r["kind"], text[r["doc_id"], r["page"], r["ord"]]) for r in scans.found(w).where("doc_id % 10 = 2 and doc_id < 10").collect()))
    assert found[0] == found[1] and {t for _, t in found[0]} == {"tbe", "brid-", "mea", "thestone", "stonc", "countcd", "19O4", "188l"}


def test_scans_of_very_long_words(spark):
    # past the lengths at which words are cut everywhere, the same is found by other ways
    long, longer = "electroencephalographically", "pneumonoultramicroscopicsilicovolcanoconiosis"
    body = [f"the {long} measured {longer} was here"] * 6
    data = [x for n in range(1, 31) for x in page(1, n, body)]
    seen = [long.replace("c", "e", 1).replace("ph", "pb", 1), longer.replace("k", "x").replace("m", "w", 1), longer + long, long + longer, "x" * 20000]
    data += page(2, 1, ["the " + " ".join(seen) + " was here"])
    w = spark.createDataFrame(data, WORDS)
    got = {r["ord"] for r in scans.found(w).where("doc_id = 2 and kind = 'misread'").collect()}
    assert got == {2, 3, 4}
    # two confusions that occur nowhere else are too unlikely to be taken, but they are weighed
    seq = scans.follow(scans.tokens(w).where("kind is null").drop("kind"))
    pairs = {(r["form"], r["candidate"], tuple(r["ops"])) for r in scans.candidates(seq, scans.unigrams(seq)).collect()}
    assert (seen[0], long, ("h>b", "c>e")) in pairs or (seen[0], long, ("c>e", "h>b")) in pairs


def test_numbers():
    assert [scans.roman_value(scans.roman(n)) for n in range(1, 400)] == list(range(1, 400))
    assert scans.frame_kinds("Papers, Vol. IV".split(), 4, 0) == ["running"] * 3
    assert scans.frame_kinds("Page l of 5".split(), 1, 0) == ["page_number"] * 4
    assert scans.frame_kinds("Chapter Two. - 19 -".split(), 9, 10) == ["running"] * 2 + ["page_number"] * 3


# problem 6


def test_packing(spark):
    rng = random.Random(3)
    texts = ["a" * rng.randrange(0, 900) for _ in range(400)] + [None, "", "é" * 700, "b" * 2499, "b" * 2500] + ["same"] * 5
    docs = spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], None, "x", "y")], DOCS)
    specs = spark.createDataFrame([(1, 500), (2, 2500), (3, 0), (1, 500)], "spec_id int, capacity_tokens int")
    got = packing.pack(docs, specs, block=100).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    for spec, cap in ((1, 500), (2, 2500)):
        mine = [r for r in got if r["spec_id"] == spec]
        per: dict = {}
        for r in mine:
            per.setdefault(r["container"], []).append(r)
        assert all(sum(r["tokens"] for r in v) <= cap and len(v) <= max(8, cap * packing.SEGMENTS_PER_1000 / 1000) for v in per.values())
        total: dict = {}
        for r in mine:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
            assert (r["n_pieces"] > 1) == (size[r["doc_id"]] > cap)
        assert total == size
        assert sum(size.values()) / (len(per) * cap) > 0.9
    assert not [r for r in got if r["spec_id"] == 3]
    assert packing.pack(docs.limit(0), specs).count() == 0


def test_packing_within_every_limit(spark):
    # 40 documents of ten tokens, half of them cue numbers that bear no loss: what a container holds is decided by the limit that is given
    cue, said = "12\n\n34\n\n\n"[:9], "abcdefghi"
    assert len(cue) == len(said) == 9
    docs = spark.createDataFrame([(i, cue if i % 2 else said, None, "x", "y") for i in range(40)], DOCS)
    loss = {r["doc_id"]: r["loss"] for r in packing.sizes(docs).collect()}
    assert loss[0] == 10 and loss[1] < 10
    shape = "spec_id int, capacity_tokens int, max_segments int, max_loss int"
    got = packing.pack(docs, spark.createDataFrame([(1, 100, None, 100), (2, 100, 4, 100), (3, 100, None, 30)], shape), segments_per_1000=1000).collect()
    per: dict = {}
    for r in got:
        per.setdefault((r["spec_id"], r["container"]), []).append(r)
    for (spec, _), v in per.items():
        assert sum(r["tokens"] for r in v) <= 100 and len(v) <= (4 if spec == 2 else 100) and sum(r["loss"] for r in v) <= (30 if spec == 3 else 100)
    count = {k: sum(s == k for s, _ in per) for k in (1, 2, 3)}
    # 400 tokens; 40 pieces by 4; the loss by 30
    assert count[1] == 4 and count[2] == 10 and count[3] >= -(-sum(loss.values()) // 30) > 4
    fill = {r["spec_id"]: r for r in packing.fill(packing.pack(docs, spark.createDataFrame([(1, 100, None, 100)], shape), segments_per_1000=1000), spark.createDataFrame([(1, 100, None, 100)], shape)).collect()}
    assert fill[1]["containers"] == 4 and fill[1]["full_tokens"] == 4 and fill[1]["filled"] == 1.0


# problem 7


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, s = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        t = np.append(rng.integers(0, s + 1, n), 0)
        ix, q = FMIndex(t, s + 1), int(rng.integers(1, 5))
        patterns = rng.integers(1, s + 1, (20, q))
        lo, hi = ix.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            assert sorted(ix.locate(np.arange(a, b)).tolist()) == [i for i in range(len(t) - q + 1) if (t[i : i + q] == p).all()]


def test_leaks(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(400)]
    passage = [" ".join(rng.sample(vocab, 40)) for _ in range(6)]
    items = [(i, p, "clash") for i, p in enumerate(passage)] + [(10, passage[0], "x"), (11, None, "x"), (12, "", "x")]
    common = ["river", "stone", "bridge", "market", "garden", "tower"]
    noise = lambda n: " ".join(rng.choice(common) for _ in range(n))
    part = lambda p, a, b: " ".join(passage[p].split()[a:b])
    cues = lambda t: "\n\n".join(f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n{' '.join(w)}" for i, w in enumerate([t.split()[k : k + 5] for k in range(0, len(t.split()), 5)]))
    miss = part(3, 0, 20).split()
    del miss[7]
    miss[12] = miss[12][:2] + "x" + miss[12][3:]
    docs = [
        (1, f"{noise(30)} {passage[0]} {noise(5)}"), (2, f"{noise(9)} {part(1, 5, 17)} {noise(9)}"), (3, f"{noise(9)} {part(1, 5, 13)} {noise(9)}"), (4, cues(f"{noise(3)} {passage[2]} {noise(8)}").upper()), (5, f"{noise(4)} {' '.join(miss)}"),
        (6, noise(50)), (7, None), (8, ""), (9, " ".join(rng.sample(vocab, 300))), (10, f"{part(4, 0, 6)} {noise(4)} {part(4, 20, 26)}"), (11, noise(3000) + " " + passage[5]),
    ]
    d = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in docs] + [(1, docs[0][1], "en", "x", "y")], DOCS).repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, passage string, word string")
    assert rows(leaks.found(d, it)) == sorted([(0, 1), (10, 1), (1, 2), (2, 4), (3, 5), (5, 11)], key=str)
    spans = {r["doc_id"]: (r["first"], r["last"]) for r in leaks.removal_spans(d, it).collect()}
    assert spans[1] == (30, 70) and spans[2] == (9, 21)
    assert leaks.found(d, it.limit(0)).count() == 0 and leaks.found(d.limit(0), it).count() == 0


def test_every_stretch_of_a_leak(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(400)]
    passage = rng.sample(vocab, 60)
    noise = ["river", "stone", "bridge", "market"]
    miswritten = [*passage[:20], "qqqqqqqq", *passage[21:]]
    apart = [*passage[:15], *(rng.choice(noise) for _ in range(25)), *passage[40:]]
    d = spark.createDataFrame([(1, " ".join(noise + miswritten + noise)), (2, " ".join(noise + apart + noise))], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, passage string")
    assert rows(leaks.removal_spans(d, it), "doc_id", "first", "last") == [(1, 4, 64), (2, 4, 19), (2, 44, 64)]


def test_leaks_are_cut_out_by_character(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(6)) for _ in range(400)]
    passage = rng.sample(vocab, 30)
    seen = [*passage[:14], passage[14][:2] + "x" + passage[14][3:], *passage[15:]]
    marked = "1\n00:00:01,000 --> 00:00:02,000\nОна <i>said</i> İ so: " + ", ".join(seen).upper() + "! (music) 𝐀nd then.\n2\n00:00:03,000 --> 00:00:04,000\nend"
    plain = "So it was. " + " ".join(passage) + " That is all."
    d = spark.createDataFrame([(1, marked), (2, plain), (3, "nothing here"), (4, "we met in Paris"), (5, "Rio, at last"), (6, None)], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(passage)), (2, "paris"), (3, "RIO at"), (4, "rio last"), (5, None)], "item_id bigint, passage string")
    assert rows(leaks.found(d, it)) == [(1, 1), (1, 2), (2, 4), (3, 5)]
    spans = leaks.removal_spans(d, it)
    text = {1: marked, 2: plain, 4: "we met in Paris", 5: "Rio, at last"}
    assert {r["doc_id"]: text[r["doc_id"]][r["start"] : r["stop"]] for r in spans.collect()} == {1: ", ".join(seen).upper(), 2: " ".join(passage), 4: "Paris", 5: "Rio, at"}
    got = dict(rows(leaks.cut_out(d, spans), "doc_id", "cleaned"))
    assert got == {1: marked.replace(", ".join(seen).upper(), " "), 2: "So it was.   That is all.", 4: "we met in  ", 5: "  last"}


# problem 8


def test_stuffed(spark):
    rng = random.Random(4)
    subject, verb, thing = ["the keeper", "my sister", "a captain", "the neighbours"], ["opened", "carried", "found", "painted"], ["the old bridge", "a letter", "the garden by the river", "some of the ledgers"]
    prose = lambda n: "\n".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} and it was {rng.choice(['late', 'cold', 'near', 'over'])}." for _ in range(n))
    adj = ["cheap", "best", "free", "online", "sale"]
    spam = [
        "\n".join(", ".join(f"{rng.choice(adj)} garden hose" for _ in range(5)) for _ in range(20)), "\n".join(" ".join(f"#{rng.choice(adj)}{rng.choice(['lamp', 'sofa', 'tea'])}" for _ in range(6)) for _ in range(20)),
        "\n".join(f"http://www.{rng.choice(adj)}-x.test/lamp/{i}" for i in range(30)), "\n".join(f"Lamp | SKU {i} | {i}.99 | {rng.choice(adj)} {rng.choice(adj)}" for i in range(20)), "\n".join(f"Our lamp is the {rng.choice(adj)} lamp for every lamp lover." for _ in range(30)),
    ]
    good = [prose(12) for _ in range(400)] + [prose(10) + "\nMore: http://a.example/1\nMore: http://b.example/2", "\n".join(["♪ la la the river ♪", "the river runs.", "the river runs."] * 8), None, ""]
    mixed = [prose(30) + "\n" + "\n".join(", ".join(f"{rng.choice(adj)} garden hose" for _ in range(5)) for _ in range(5))]
    texts = good + mixed + spam
    docs = spark.createDataFrame([(i, t, "en" if i % 9 else None, "x", "y") for i, t in enumerate(texts)] * 2, DOCS)
    n = len(good) + len(mixed)
    assert rows(stuffed.found(docs)) == sorted([(i,) for i in range(n, n + len(spam))], key=str)
    assert stuffed.found(docs.limit(0)).count() == 0


def test_stuffed_copies_are_no_usual_page(spark):
    rng = random.Random(6)
    prose = lambda: "\n".join(f"{rng.choice(['the keeper', 'my sister', 'a captain'])} {rng.choice(['opened', 'carried', 'found'])} {rng.choice(['the old bridge', 'a letter', 'the garden'])} and it was {rng.choice(['late', 'cold'])}." for _ in range(20))
    lamp = "\n".join("Our lamp is the best lamp for every lamp lover." for _ in range(20))
    hose = "\n".join(", ".join(["cheap garden hose"] * 5) for _ in range(13))
    texts = [prose() for _ in range(300)] + [lamp] * 400 + [hose] * 200
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts)], DOCS)
    assert rows(stuffed.found(docs)) == sorted([(i,) for i in range(300, len(texts))], key=str)


def test_stuffed_near_copies_are_no_usual_page(spark):
    # every copy differs a little, so each is a text of its own and they are the most of their length
    rng = random.Random(8)
    subject, verb, thing = ["the keeper", "my sister", "a captain"], ["opened", "carried", "found"], ["the old bridge", "a letter", "the garden"]
    prose = lambda n: "\n".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} and it was {rng.choice(['late', 'cold'])} on day {rng.randrange(99)}." for _ in range(n))
    good = [prose(rng.choice([4, 8, 16, 32, 64])) for _ in range(300)]
    spam = ["\n".join(", ".join(["cheap garden hose"] * 5) for _ in range(13)) + f"\nhose {i}, hose, garden hose, cheap hose" for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(good + spam)], DOCS)
    assert rows(stuffed.found(docs)) == sorted([(i,) for i in range(300, 450)], key=str)


def test_stuffed_is_decided_by_the_curve(spark, monkeypatch):
    # the exact check sees flagged pages only: without extreme curves nothing is found
    texts = ["the keeper opened a letter and it was late on a cold day.\n" * 5] * 20 + ["\n".join(", ".join(["cheap garden hose"] * 5) for _ in range(13))]
    docs = spark.createDataFrame([(i, t + str(i), "en", "x", "y") for i, t in enumerate(texts)], DOCS)
    assert rows(stuffed.found(docs)) == [(20,)]
    monkeypatch.setattr(stuffed, "flagged", lambda measured, ref: measured.select("digest").limit(0))
    assert rows(stuffed.found(docs)) == []


def test_curve_is_least_squares(spark):
    docs = spark.createDataFrame([(1, "a a a a b b b c c d", "en", "x", "y")], DOCS)
    got = stuffed.measures(docs).first()
    x, y = np.log([1, 2, 3, 4]), np.log([4, 3, 2, 1])
    slope, base = np.polyfit(x, y, 1)
    assert abs(got["slope"] - slope) < 1e-5 and abs(got["residual"] - np.sqrt(((y - base - slope * x) ** 2).mean())) < 1e-5


# the registered queries


FOUND = {
    "p2_found": "doc_id bigint, page int, line int", "p3_found": "src string, doc_id bigint, page int, line int, name string, kind string", "p4_found": "src string, doc_id bigint, page int, line int, name string",
    "p5_found": "doc_id bigint, page int, ord int, kind string", "p6_found": "spec_id int, doc_id bigint", "p7_found": "item_id bigint, doc_id bigint", "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, name):
    df = R.queries[name](spark, DATA)
    if name in FOUND:
        assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == FOUND[name]
    if sql := R.sql.get(name):
        compare(spark, connect(), lambda *_: df, sql)
    else:
        assert df.columns and df.count() >= 0
