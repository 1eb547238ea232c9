from docengine.llm import scans

LINES = "the borrower drew funds under the revolving line to fund printing inventory and the lender agreed".split()


def _pages(spark, extra=()):
    rows = []
    for doc in range(6):
        for page in range(1, 5):
            body = [f"{' '.join(LINES[8 * (k % 2) : 8 + 8 * (k % 2)])} {2000 + 100 * doc + 10 * page + k}" for k in range(6)]
            rows.append((f"d{doc}", page, [f"Confidential: Firm {doc}x    Page {page}", *body, f"- {page} -"], "old", 7))
    return spark.createDataFrame([*rows, *extra], "doc_id string, page_no int, raw_lines array<string>, content string, kind int")


def test_trie_finds_all_misreadings():
    words = {"maintenance": 90, "holds": 90, "folds": 90, "agreed": 50, "statements": 9}
    trie = scans.Trie(words)
    assert trie.candidates("mainfenancc") == {"maintenance": 2}
    assert set(trie.candidates("liolds")) == {"holds"} and set(trie.candidates("staternents")) == {"statements"}
    assert trie.candidates("zzzz") == {}


def test_numbers_and_page_numbers():
    assert scans.misread_number("$2l,488,829") == "$21,488,829" and scans.misread_number("FY2021") is None and scans.misread_number("2.97x") is None
    assert scans.shows_page("- 12 -", 12) and scans.shows_page("Pagc 3 of 1O", 3) and scans.shows_page("lii", 3) and scans.shows_page("xiv", 14)
    assert not scans.shows_page("2023", 5) and not scans.shows_page("430,520", 4)


def test_marks(spark):
    extra = [
        ("z", 1, ["the borrowcr drew funds under the revol-", "ving line to fund prin ting inventory.", "he paid $2l,488,829 to the len-", "p. 1"], "x", 7),
        ("z", 2, ["der agreed and the line", ""], None, 7),
        ("z", 2, ["der agreed and the line", ""], None, 7),
        ("n", 1, None, None, 7), ("m", 1, [], None, 7), ("e", 1, ["", None, "   "], "", 7), (None, 1, ["a"], "", 7), ("q", None, ["a"], "", 7),
    ]
    got = {(r["doc_id"], r["page_no"], r["line_no"], r["kind"]) for r in scans.marks(_pages(spark, extra)).collect()}
    z = {g[1:] for g in got if g[0] == "z"}
    assert z == {(1, 0, "ocr"), (1, 0, "hyphen"), (1, 1, "ocr"), (1, 2, "ocr"), (1, 2, "hyphen"), (1, 3, "furniture")}
    d = {g[1:] for g in got if g[0] == "d0"}
    assert d == {(p, i, "furniture") for p in range(1, 5) for i in (0, 7)}
    assert {g[0] for g in got} <= {"z", *(f"d{i}" for i in range(6))}


def test_repaired_text(spark):
    extra = [("z", 1, ["the borrowcr drew funds under the revol-", "ving line to fund prin ting inventory.", "", "- the lender agreed", "p. 1"], "x", 7)]
    row = scans.repaired_pages(_pages(spark, extra)).where("doc_id = 'z'").first()
    assert row["content"] == "the borrower drew funds under the revolving line to fund printing inventory.\n\n- the lender agreed"
    assert len(row["repair_applied"]) == 4


def test_empty(spark):
    assert scans.marks(_pages(spark).limit(0)).count() == 0 and scans.repaired_pages(_pages(spark).limit(0)).count() == 0


def test_suspended_hyphens(spark):
    extra = [("z", 1, ["the short-", "and long lines of thous-", "and lenders"], "x", 7)] + [("y", p, [f"a thousand {p} of them", f"or {p} lines"], "x", 7) for p in range(1, 5)]
    got = {(r["line_no"], r["kind"]) for r in scans.marks(_pages(spark, extra)).where("doc_id = 'z'").collect()}
    assert got == {(1, "hyphen")}


def test_words_of_one_file(spark):
    drew = lambda *names: [f"{n} drew funds under the line" for n in names]
    extra = [
        ("k", 1, drew(*["Kesmimoor"] * 3, "Kcsmimoor", *["Kesmimoor"] * 4, "Kesm!moor", "Dane-Kcsmimoor") + ["the lender agreed", "and the line", "to fund inventory", "under the line"], "x", 7),
        ("h", 1, drew(*["lender"] * 100, *["lendcr"] * 30), "x", 7),
        ("f", 1, drew(*["tax"] * 5, "fax"), "x", 7), ("g", 1, drew(*["fax"] * 4), "x", 7),
    ]
    got = {(r["doc_id"], r["line_no"], r["word"], r["meant"]) for r in scans.marks(_pages(spark, extra)).where("kind = 'ocr'").collect()}
    assert got == {("k", 3, "Kcsmimoor", "Kesmimoor"), ("k", 8, "Kesm!moor", "Kesmimoor"), ("k", 9, "Dane-Kcsmimoor", "Dane-Kesmimoor"), *(("h", i, "lendcr", "lender") for i in range(100, 130))}


def test_misread_words_broken_over_pages_and_furniture(spark):
    full = ["the lender agreed to fund inventory", "and the line"]
    extra = [
        ("z", 1, [*full, "he bought inven-"], "x", 7), ("z", 2, ["t0ry and the line", *full], "x", 7),
        ("y", 1, [*full, *full, "he asked the borr-", "0wer to agree", *full], "x", 7),
        ("w", 1, [*full, "he bought lnven-", "p. 1"], "x", 7), ("w", 2, ["p. 2", "tory and the line", *full], "x", 7),
    ]
    pages = _pages(spark, extra)
    got = {(r["doc_id"], r["page_no"], r["line_no"], r["kind"]) for r in scans.marks(pages).where("doc_id in ('w', 'y', 'z') and kind <> 'furniture'").collect()}
    assert got == {("z", 1, 2, "hyphen"), ("z", 2, 0, "ocr"), ("y", 1, 4, "hyphen"), ("y", 1, 5, "ocr"), ("w", 1, 2, "hyphen"), ("w", 1, 2, "ocr")}
    row = scans.repaired_pages(pages).where("doc_id = 'y'").first()
    assert "he asked the borrower to agree" in row["content"]
    content = {r["page_no"]: r["content"] for r in scans.repaired_pages(pages).where("doc_id in ('w', 'z')").select("doc_id", "page_no", "content").collect() if r["doc_id"] == "w"}
    assert "he bought inventory" in content[1] and content[2].startswith("and the line")


def test_any_edit_is_found_and_ranked_in_context(spark):
    some = [f"the {w} of the {v} unit" for w, v in (("company", "first"), ("covenant", "lender"))]
    extra = [("c", p, [*some * 2100], "x", 7) for p in range(1, 3)] + [("z", 1, ["a line of text", "the compny of the first unit", "the zompany stays", "he has a compny"], "x", 7)]
    got = {(r["line_no"], r["word"], r["meant"]) for r in scans.marks(_pages(spark, extra)).where("doc_id = 'z' and kind = 'ocr'").collect()}
    assert got == {(1, "compny", "company"), (2, "zompany", "company")}  # without a known neighbour nothing is said


def test_several_candidates_are_ranked_in_context(spark):
    body = ["the tax fell due", "a fox ran off"] * 60
    extra = [("c", 1, body, "x", 7), ("z", 1, ["the !ine", "the t@x fell due", "a f0x ran off"], "x", 7)]
    words = {(r["word"], r["meant"]) for r in scans.marks(_pages(spark, extra)).where("doc_id = 'z' and kind = 'ocr'").collect()}
    assert {("t@x", "tax"), ("f0x", "fox")} <= words
