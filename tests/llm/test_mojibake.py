from html.entities import codepoint2name

from docengine.llm import mojibake as m

CLEAN = ["Le château évalué a été donné en gage jusqu’au 3 mai.", "La línea de crédito se amplió según el señor.", "The lender’s counsel – agreed. See § 12 and €500.", "Für die Bürgschaft wären größere Beträge nötig."]


def _docs(spark, extra):
    rows = [(i, CLEAN[i % 4] + f" Number {i}.", "x", True) for i in range(400)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, restored string, lost boolean")


def test_restores_what_was_garbled(spark):
    bad = {}
    for k, (wrote, read, times) in enumerate([("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp1251", 1), ("cp1252", "mac_roman", 1), ("utf-8", "cp1252", 2)]):
        for j, text in enumerate(CLEAN):
            t = text
            try:
                for _ in range(times):
                    t = t.encode(wrote).decode(read)
            except UnicodeError:
                continue
            bad[1000 + 10 * k + j] = (t, text)
    extra = [(d, t, None, None) for d, (t, _) in bad.items()]
    extra += [(1, CLEAN[1], None, None), (2000, None, None, None), (2001, "", None, None), (2002, "plain ascii", None, None), (2003, "lost � here", None, None), (2004, "The Тарволен name", None, None), (2005, "The √2 rule, ±0.5 at 4 °C", None, None), (2006, CLEAN[0] * 3_000, None, None), (None, "lost �", None, None), (2**60 + 1, "lost �", None, None)]
    got = {r["doc_id"]: r for r in m.garbled_documents(_docs(spark, extra)).collect()}
    assert set(got) == {*bad, 2003, None, 2**60 + 1}
    assert sum(got[d]["restored"] == text for d, (_, text) in bad.items()) >= 0.95 * len(bad)
    assert got[2003]["lost"] and not got[1000]["lost"]


def test_empty(spark):
    assert m.garbled_documents(_docs(spark, []).limit(0)).count() == 0


def test_frequent_garbling_is_found(spark):
    garble = lambda t: t.encode("utf-8").decode("cp1252")
    rows = [(i, garble(CLEAN[i % 4] + f" Number {i}.") if i % 3 == 0 else CLEAN[i % 4] + f" Number {i}.") for i in range(400)]
    rows += [(1000 + i, "Le château a été donné à l’époque du prêt.".encode("cp1252").decode("mac_roman") + f" Nr. {i}") for i in range(100)]
    rows += [(2000 + i, "Le château a été donné à l’époque du prêt." + f" Nr. {i}") for i in range(200)]
    got = {r["doc_id"]: r["restored"] for r in m.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {*range(0, 400, 3), *range(1000, 1100)}
    assert all(got[i] == CLEAN[i % 4] + f" Number {i}." for i in range(0, 400, 3)) and got[1005] == "Le château a été donné à l’époque du prêt. Nr. 5"


def test_garbled_and_escaped(spark):
    sound = "Für die Bürgschaft wären größere Beträge nötig."
    bad = sound.encode("utf-8").decode("cp1252")
    names = lambda t: "".join(f"&{codepoint2name[ord(c)]};" if ord(c) > 127 else c for c in t)
    number = lambda t: t.encode("ascii", "xmlcharrefreplace").decode()
    extra = [(1000, names(bad)), (1001, number(bad)), (1002, names(bad).replace("&", "&amp;")), (1003, "Größe & Co. " + names(bad)), (2000, names(sound)), (2001, number(sound)), (2002, "A &amp; B &lt; C"), (2003, "Größe &uuml;ber 5")]
    docs = _docs(spark, [(i, t, None, None) for i, t in extra])
    got = {r["doc_id"]: r["restored"] for r in m.garbled_documents(docs).collect()}
    assert got == {1000: sound, 1001: sound, 1002: sound, 1003: "Größe & Co. " + sound}


def test_a_search_at_its_bound_says_so(spark, monkeypatch):
    text = CLEAN[0]
    for _ in range(2):
        text = text.encode("utf-8").decode("cp1252", "replace")
    docs = _docs(spark, [(1000, text, None, None)])
    assert m.plausibility(docs).load() < 0.01
    model = m.plausibility(docs)
    monkeypatch.setattr(m, "MAX_STATES", 0)
    m.repair(text, model)
    assert model.unfinished
