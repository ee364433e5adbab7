import pytest

from tallyforge.llm.names import WORDS, Vocabulary, distance, formal_names, misspelt, organisation, parse, shortens, state_form, town_form, zip_form

COMMON = Vocabulary(frozenset(WORDS.values()) | frozenset("NURSES REALTORS HILLS LOCAL UNION FIREFIGHTERS POLITICAL ACTION COMMITTEE STRATEGIES AND THE OF FOR".split()))


def key(last, first=None, kind=None):
    n = parse(last, first, kind, COMMON)
    return n.kind, n.heads[0], tuple(n.formal), n.initials, n.office, n.year


@pytest.mark.parametrize(
    "last, first",
    [("Smithers", "William T."), ("SMITHERS", "T. WILLIAM"), ("WILLIAM", "SMITHERS T"), ("SMITHERS, WILLIAM T", None), ("William T Smithers", None), ("SMITHERS, MD", "WILLIAM T"), ("SMI-THERS", "Dr. William T"), ("SMITH ERS", "WILLIAM T"), ("SMITHERS", "WILIAM T")],
)
def test_people(last, first):
    assert key(last, first) == ("P", "SMITHERS", ("WILLIAM",), "T", "", "")


def test_nicknames_and_initials():
    assert formal_names("BILL") == {"WILLIAM"} and formal_names("SAM") == {"SAMANTHA", "SAMUEL"} and formal_names("XYZ") == frozenset()
    assert key("SMITHERS", 'WILLIAM "BILL"')[2] == ("WILLIAM",)
    assert key("SMITHERS", "W.T.")[2:4] == ((), "WT") and key("SMITHERS", "W")[2:4] == ((), "W")


@pytest.mark.parametrize("text", ["Smithers for Assembly 2020", "SMITHERS 4 ASM '20", "CMTE TO ELECT SMITHERS ASSY 2020", "2020 SMITHERS FOR ASSEMBLY", "RE-ELECT SMITHERS ASSEMBLY '20", "'20 Smithers for Assembly"])
def test_campaigns(text):
    assert key(text) == ("C", "SMITHERS", (), "", "ASSEMBLY", "2020")


def test_campaigns_with_given_names():
    for text in ("FRIENDS OF BILL SMITHERS FOR CITY CNCL 2022", "CITY COUNCIL '22 - SMITHERS, WILLIAM", "SMITHERS, WILL FOR CITY COUNCL, 2022"):
        assert key(text) == ("C", "SMITHERS", ("WILLIAM",), "", "CITY COUNCIL", "2022")


@pytest.mark.parametrize("text", ["VANDERBLOK HILLS NURSES POLITICAL ACTION COMMITTEE", "Vanderblok Hills Nurses PAC", "NURSES P.A.C. FOR VANDERBLOK HILLS", "THE VANDERBLOK, HILLS NURSES POL ACTION CMTE (VHNPAC)", "NURSES POLITICAL ACTION COMTE / VANDERBLOK HILLS", "VANDERBLOK HILLS NURSSE POLITICAL ACTION COMM"])
def test_organisations(text):
    n = parse(text, None, "COM", COMMON)
    assert (n.kind, n.heads, n.words) == ("O", ["VANDERBLOK"], ["ACTION", "COMMITTEE", "HILLS", "NURSES", "POLITICAL"])


def test_numbers_and_blanks():
    a, b = (organisation(t, COMMON) for t in ("VANDERBLOK NURSES UNION LOCAL 12", "VANDERBLOK NURSES UNION, # 12"))
    assert (a.heads, a.words, a.numbers) == (b.heads, b.words, b.numbers) == (["VANDERBLOK"], ["NURSES", "UNION"], "12")
    assert organisation("VANDERBLOK FIRE FIGHTERS", COMMON).words == ["FIREFIGHTERS"]
    assert organisation("VANDER BLOK NURSES", COMMON).heads[-1] == "VANDERBLOK"


@pytest.mark.parametrize("last, first", [("", ""), ("-", None), ("   ", " "), ("?!", "?!"), ("1", None), ("É", "É"), ("A" * 5000, None)])
def test_odd_names_do_not_crash(last, first):
    parse(last, first, None, COMMON)
    parse(last, first, "IND", Vocabulary())


def test_places():
    assert town_form(" N.  Gandado ") == town_form("NORTH GANDADO") == "NORTH GANDADO"
    assert (state_form("Calif."), state_form("d.c."), state_form(None), state_form("Atlantis")) == ("CA", "DC", "", "")
    assert (zip_form("12345-6789"), zip_form(" 12345"), zip_form("123"), zip_form(None)) == ("12345", "12345", "", "")


def test_short_forms():
    good = {"ASSOCIATN": "ASSOCIATION", "BHD": "BROTHERHOOD", "WKRS": "WORKERS", "FIREFTRS": "FIREFIGHTERS", "ALLNC": "ALLIANCE", "VLY": "VALLEY", "CONSLTG": "CONSULTING", "MNGMNT": "MANAGEMENT", "HSPTL": "HOSPITAL"}
    assert all(shortens(a, b) for a, b in good.items())
    bad = {"FIRE": "FIREFIGHTERS", "FIGHTERS": "FIREFIGHTERS", "TREE": "TREASURER", "ART": "APARTMENT", "OFFICES": "OFFICERS", "SMITH": "SMITHSON", "UNION": "UNIONS"}
    assert not any(shortens(a, b) for a, b in bad.items())
    v = Vocabulary.of({"TEACHERS": 50, "TEACHRS": 8, "TCHRS": 9, "OFFICES": 9, "OFFICERS": 30, "COUNCL": 5, "COUNCIL": 30}, frozenset(["KEVIN"]))
    assert v.alias == {"TEACHRS": "TEACHERS", "TCHRS": "TEACHERS", "COUNCL": "COUNCIL"} and "OFFICES" in v.common
    assert organisation("X THCRS COUNCL", v).words == ["COUNCIL", "TEACHERS"]
    assert parse("KEVIN SMITHERS", None, None, v).kind == "P" and parse("KEVIN SMITHERS", None, None, Vocabulary()).kind == "O"
    assert misspelt({"GERALD": 100, "GERAALD": 5, "KEVIN": 50}) == {"GERAALD"}


def test_distance():
    assert [distance(*p) for p in [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "abcd")]] == [0, 1, 1, 3, 4]
