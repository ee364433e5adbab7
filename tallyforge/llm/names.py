"""Names of people, campaigns and organisations taken apart into comparable parts."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

# Everyday forms of given names. A form may stand for several names.
GIVEN = {
    "ABIGAIL": ["ABBY", "GAIL"],
    "ALAN": ["AL"],
    "ALBERT": ["AL", "BERT", "BERTIE"],
    "ALEXANDER": ["ALEX", "AL"],
    "ALFRED": ["AL", "FRED"],
    "ALLISON": ["ALLIE"],
    "AMANDA": ["MANDY"],
    "ANDREW": ["ANDY", "DREW"],
    "ANGELA": ["ANGIE"],
    "ANTHONY": ["TONY"],
    "ANTONIO": ["TONY"],
    "ARTHUR": ["ART"],
    "BARBARA": ["BARB", "BABS"],
    "BARTHOLOMEW": ["BART"],
    "BENJAMIN": ["BEN", "BENNY"],
    "BERNARD": ["BERNIE"],
    "BEVERLY": ["BEV"],
    "BRADLEY": ["BRAD"],
    "CALVIN": ["CAL"],
    "CAROLINE": ["CARRIE"],
    "CASSANDRA": ["CASSIE"],
    "CATHERINE": ["CATHY", "KATE"],
    "CHARLES": ["CHARLIE", "CHUCK"],
    "CHARLOTTE": ["LOTTIE"],
    "CHRISTINE": ["CHRIS", "TINA"],
    "CHRISTOPHER": ["CHRIS", "KIT"],
    "CLIFFORD": ["CLIFF"],
    "CLINTON": ["CLINT"],
    "CONSTANCE": ["CONNIE"],
    "CYNTHIA": ["CINDY"],
    "DANIEL": ["DAN", "DANNY"],
    "DAVID": ["DAVE"],
    "DEBORAH": ["DEB", "DEBBIE"],
    "DENNIS": ["DENNY"],
    "DONALD": ["DON", "DONNIE"],
    "DOROTHY": ["DOT", "DOTTIE"],
    "DOUGLAS": ["DOUG"],
    "EDMUND": ["ED", "NED"],
    "EDWARD": ["ED", "EDDIE", "TED", "NED"],
    "EDWIN": ["ED"],
    "ELEANOR": ["ELLIE", "NELL", "NORA"],
    "ELIZABETH": ["LIZ", "BETH", "BETTY", "ELIZA", "LIBBY"],
    "EMILY": ["EM"],
    "ERNEST": ["ERNIE"],
    "EUGENE": ["GENE"],
    "FLORENCE": ["FLO"],
    "FRANCES": ["FRAN"],
    "FRANCIS": ["FRANK"],
    "FRANCISCO": ["FRANK", "PACO", "PANCHO"],
    "FREDERICK": ["FRED", "FREDDY"],
    "GABRIEL": ["GABE"],
    "GEOFFREY": ["GEOFF", "JEFF"],
    "GERALD": ["GERRY", "JERRY"],
    "GILBERT": ["GIL"],
    "GREGORY": ["GREG"],
    "GUADALUPE": ["LUPE", "LUPITA"],
    "GWENDOLYN": ["GWEN"],
    "HANNAH": [],
    "HAROLD": ["HAL", "HARRY"],
    "HENRIETTA": ["ETTA", "HETTY"],
    "HENRY": ["HANK", "HARRY"],
    "HERBERT": ["HERB"],
    "HOWARD": ["HOWIE"],
    "IGNACIO": ["NACHO"],
    "ISAAC": ["IKE"],
    "ISABELLA": ["BELLA", "IZZY"],
    "JACOB": ["JAKE"],
    "JACQUELINE": ["JACKIE"],
    "JAMES": ["JIM", "JIMMY", "JAMIE"],
    "JANICE": ["JAN"],
    "JEFFREY": ["JEFF"],
    "JENNIFER": ["JEN", "JENNY"],
    "JEROME": ["JERRY"],
    "JESSICA": ["JESS", "JESSIE"],
    "JESUS": ["CHUY"],
    "JOHN": ["JACK", "JOHNNY"],
    "JONATHAN": ["JON"],
    "JOSE": ["PEPE"],
    "JOSEPH": ["JOE", "JOEY"],
    "JOSEPHINE": ["JO", "JOSIE"],
    "JOSHUA": ["JOSH"],
    "JUDITH": ["JUDY"],
    "KATHERINE": ["KATE", "KATHY", "KATIE", "KAY"],
    "KENNETH": ["KEN", "KENNY"],
    "KIMBERLY": ["KIM"],
    "LAWRENCE": ["LARRY"],
    "LEONARD": ["LEN", "LENNY", "LEO"],
    "LILLIAN": ["LIL", "LILLY"],
    "LOUIS": ["LOU"],
    "LOUISE": ["LOU"],
    "LUCILLE": ["LUCY"],
    "MADELINE": ["MADDIE"],
    "MANUEL": ["MANNY"],
    "MARGARET": ["MAGGIE", "PEG", "PEGGY", "MEG"],
    "MARTHA": ["MARTY"],
    "MARTIN": ["MARTY"],
    "MARVIN": ["MARV"],
    "MATTHEW": ["MATT"],
    "MAXWELL": ["MAX"],
    "MELISSA": ["LISSA"],
    "MICHAEL": ["MIKE", "MICK"],
    "MILTON": ["MILT"],
    "MITCHELL": ["MITCH"],
    "NANCY": ["NAN"],
    "NATHANIEL": ["NAT", "NATE"],
    "NICHOLAS": ["NICK"],
    "NORMAN": ["NORM"],
    "OLIVER": ["OLLIE"],
    "OLIVIA": ["LIV", "LIVVY"],
    "OSCAR": ["OZZIE"],
    "PAMELA": ["PAM"],
    "PATRICIA": ["PAT", "TRISH", "PATTY", "TRICIA"],
    "PATRICK": ["PAT", "PADDY"],
    "PETER": ["PETE"],
    "PHILIP": ["PHIL"],
    "PHILLIP": ["PHIL"],
    "QUENTIN": ["QUINN"],
    "RAFAEL": ["RAFA"],
    "RANDALL": ["RANDY"],
    "RAYMOND": ["RAY"],
    "REBECCA": ["BECKY"],
    "REGINALD": ["REGGIE"],
    "RICHARD": ["DICK", "RICK", "RICH"],
    "ROBERT": ["BOB", "ROB", "BOBBY"],
    "ROBERTO": ["BETO"],
    "RONALD": ["RON", "RONNIE"],
    "ROSEMARY": ["ROSE", "ROSIE"],
    "RUSSELL": ["RUSS"],
    "SALVADOR": ["CHAVA"],
    "SAMANTHA": ["SAM"],
    "SAMUEL": ["SAM"],
    "SANDRA": ["SANDY"],
    "SARAH": ["SALLY"],
    "SOLOMON": ["SOL"],
    "STANLEY": ["STAN"],
    "STEPHEN": ["STEVE"],
    "STEVEN": ["STEVE"],
    "STUART": ["STU"],
    "SUSAN": ["SUE", "SUSIE"],
    "TERESA": ["TERRY", "TESS"],
    "THADDEUS": ["THAD"],
    "THEODORA": ["DORA", "THEA"],
    "THEODORE": ["TED", "THEO"],
    "THOMAS": ["TOM", "TOMMY"],
    "TIMOTHY": ["TIM"],
    "URSULA": ["URSIE"],
    "VALERIE": ["VAL"],
    "VERNON": ["VERN"],
    "VICTORIA": ["VICKY", "TORI"],
    "VINCENT": ["VINCE"],
    "VIRGINIA": ["GINNY"],
    "VIVIAN": ["VIV"],
    "WALLACE": ["WALLY"],
    "WALTER": ["WALT", "WALLY"],
    "WILLIAM": ["BILL", "WILL", "BILLY"],
    "WINIFRED": ["WINNIE"],
    "YOLANDA": ["YOLI"],
    "ZACHARY": ["ZACH", "ZACK"],
}
# Titles and suffixes that are no part of a name.
TITLES = "MR MRS MS DR HON REV JR SR II III IV MD CPA ESQ PHD DDS".split()
# Offices and how they are shortened.
OFFICES = {
    "ASSEMBLY": "ASM ASSY ASSEMBLYMEMBER", "SENATE": "SEN SENATOR", "MAYOR": "", "SCHOOL BOARD": "SCHOOLBOARD", "TREASURER": "TREAS", "SUPERVISOR": "SUPV SUPVR",
    "CITY COUNCIL": "COUNCIL", "GOVERNOR": "GOV", "CONGRESS": "", "HOUSE": "",
}
# Usual short forms in names of committees, unions and firms; others are read by rule (see shortens).
WORDS = {
    "ASSN": "ASSOCIATION",
    "ASSOC": "ASSOCIATION",
    "CMTE": "COMMITTEE",
    "COMM": "COMMITTEE",
    "POL": "POLITICAL",
    "INC": "INCORPORATED",
    "CO": "COMPANY",
    "CORP": "CORPORATION",
    "FED": "FEDERATION",
    "UN": "UNION",
    "LOC": "LOCAL",
    "LCL": "LOCAL",
    "SVC": "SERVICES",
    "SVCS": "SERVICES",
    "GRP": "GROUP",
    "ADV": "ADVERTISING",
    "CNTY": "COUNTY",
    "CTY": "COUNTY",
    "NO": "NORTHERN",
    "N": "NORTHERN",
    "SO": "SOUTHERN",
    "S": "SOUTHERN",
    "DEPT": "DEPARTMENT",
    "INTL": "INTERNATIONAL",
    "NATL": "NATIONAL",
    "MGMT": "MANAGEMENT",
    "DIST": "DISTRICT",
    "UNIV": "UNIVERSITY",
    "GOVT": "GOVERNMENT",
    "BROS": "BROTHERS",
    "MFG": "MANUFACTURING",
    "BLDG": "BUILDING",
    "CNCL": "COUNCIL",
    "CTR": "CENTER",
    "ORG": "ORGANIZATION",
    "SOC": "SOCIETY",
    "HOSP": "HOSPITAL",
    "INS": "INSURANCE",
    "TRANSP": "TRANSPORTATION",
    "ENGRS": "ENGINEERS",
    "EMPL": "EMPLOYEES",
    "EMPS": "EMPLOYEES",
    "WKRS": "WORKERS",
    "VAL": "VALLEY",
    "CONTR": "CONTRIBUTOR",
    "CONTRIB": "CONTRIBUTOR",
}
# Trades and other words that many organisations have in their names; a corpus adds its own (see vocabulary).
TRADES = [
    "ACCOUNTANTS", "ADVERTISING", "AGENTS", "AGRICULTURE", "ALLIANCE", "APARTMENT", "ARCHITECTS", "ASSOCIATES", "ATTORNEYS", "AUTO", "BANKERS",
    "BEVERAGE", "BOARD", "BROKERS", "BROTHERHOOD", "BUILDERS", "BUSINESS", "CARPENTERS", "CATERING", "CHAMBER", "CHIROPRACTORS", "CITIZENS", "CLUB",
    "COALITION", "COLLEGE", "COMMERCE", "COMMUNITY", "CONSTRUCTION", "CONSULTING", "CONTRACTORS", "CONTRIBUTOR", "CORRECTIONAL", "DEALERS",
    "DENTISTS", "DEVELOPERS", "DIGITAL", "DISTRIBUTORS", "EDUCATION", "ELECTRICAL", "ENERGY", "ENTERPRISES", "ESTATE", "EVENTS", "FACULTY", "FARMERS",
    "FIREFIGHTERS", "FOUNDATION", "FUND", "GROCERS", "GROWERS", "GUILD", "HEALTH", "HOLDINGS", "HOMEOWNERS", "HOUSING", "INDUSTRIES", "INSTITUTE",
    "INVESTMENTS", "LABORERS", "LAW", "LEAGUE", "MACHINISTS", "MEDIA", "MERCHANTS", "NETWORK", "NURSES", "OFFICERS", "OFFICES", "OPTOMETRISTS",
    "OWNERS", "PAINTERS", "PARTNERS", "PHARMACISTS", "PHYSICIANS", "PILOTS", "PLUMBERS", "PODIATRISTS", "POLICE", "POLLING", "PRINCIPALS", "PRINTING",
    "PROPERTIES", "PSYCHOLOGISTS", "RANCHERS", "REALTORS", "RESEARCH", "RESTAURANT", "RETAILERS", "SCHOOL", "SMALL", "STRATEGIES", "STUDENTS",
    "SUPERVISORS", "TAXPAYERS", "TEACHERS", "TEAMSTERS", "TECHNOLOGY", "TELEPHONE", "TRADES", "TRANSIT", "TRUCKERS", "VETERANS", "VINTNERS",
    "WORKERS",
]
# Legal forms and fillers that may be left out of an organisation's name (CO. may be a company or a county).
DROPPED = "INCORPORATED CORPORATION COMPANY LLC LTD THE OF FOR AND LOCAL COUNTY".split()
# Words that stand around a candidate's name.
CAMPAIGN = "FOR FRIENDS OF COMMITTEE TO ELECT RE REELECT VOTE CAMPAIGN THE".split()
# Shortened words in names of towns.
TOWN = {"N": "NORTH", "NO": "NORTH", "S": "SOUTH", "SO": "SOUTH", "E": "EAST", "W": "WEST", "ST": "SAINT", "FT": "FORT", "MT": "MOUNT", "PT": "PORT", "SPGS": "SPRINGS", "SPG": "SPRINGS", "BCH": "BEACH"}
_PARTS = frozenset([*TOWN.values(), "SAN", "SANTA", "LOS", "LAS"])
# The states with their other spellings.
STATE_NAMES = {
    "AL": ["ALABAMA", "ALA"],
    "AK": ["ALASKA"],
    "AZ": ["ARIZONA", "ARIZ"],
    "AR": ["ARKANSAS", "ARK"],
    "CA": ["CALIFORNIA", "CALIF", "CAL"],
    "CO": ["COLORADO", "COLO"],
    "CT": ["CONNECTICUT", "CONN"],
    "DE": ["DELAWARE", "DEL"],
    "DC": ["DISTRICTOFCOLUMBIA"],
    "FL": ["FLORIDA", "FLA"],
    "GA": ["GEORGIA", "GA"],
    "HI": ["HAWAII"],
    "ID": ["IDAHO"],
    "IL": ["ILLINOIS", "ILL"],
    "IN": ["INDIANA", "IND"],
    "IA": ["IOWA"],
    "KS": ["KANSAS", "KANS"],
    "KY": ["KENTUCKY", "KY"],
    "LA": ["LOUISIANA", "LA"],
    "ME": ["MAINE"],
    "MD": ["MARYLAND", "MD"],
    "MA": ["MASSACHUSETTS", "MASS"],
    "MI": ["MICHIGAN", "MICH"],
    "MN": ["MINNESOTA", "MINN"],
    "MS": ["MISSISSIPPI", "MISS"],
    "MO": ["MISSOURI", "MO"],
    "MT": ["MONTANA", "MONT"],
    "NE": ["NEBRASKA", "NEBR"],
    "NV": ["NEVADA", "NEV"],
    "NH": ["NEWHAMPSHIRE"],
    "NJ": ["NEWJERSEY"],
    "NM": ["NEWMEXICO"],
    "NY": ["NEWYORK"],
    "NC": ["NORTHCAROLINA"],
    "ND": ["NORTHDAKOTA"],
    "OH": ["OHIO"],
    "OK": ["OKLAHOMA", "OKLA"],
    "OR": ["OREGON", "ORE"],
    "PA": ["PENNSYLVANIA", "PENN"],
    "RI": ["RHODEISLAND"],
    "SC": ["SOUTHCAROLINA"],
    "SD": ["SOUTHDAKOTA"],
    "TN": ["TENNESSEE", "TENN"],
    "TX": ["TEXAS", "TEX"],
    "UT": ["UTAH"],
    "VT": ["VERMONT", "VT"],
    "VA": ["VIRGINIA", "VA"],
    "WA": ["WASHINGTON", "WASH"],
    "WV": ["WESTVIRGINIA"],
    "WI": ["WISCONSIN", "WIS"],
    "WY": ["WYOMING", "WYO"],
}
STATES = {name: code for code, names in STATE_NAMES.items() for name in names if len(name) > 2}

FORMAL: dict[str, frozenset[str]] = {}
for _name, _forms in GIVEN.items():
    for _f in [_name, *_forms]:
        FORMAL[_f] = FORMAL.get(_f, frozenset()) | {_name}
OFFICE_OF = {short: office for office, shorts in OFFICES.items() for short in [office, *shorts.split()]}
_OFFICE = re.compile(r"\b(?:ST |STATE )?(" + "|".join(sorted((re.escape(o) for o in OFFICE_OF), key=len, reverse=True)) + r"|CITY (?:COUNCL|CNCL)|CIT[A-Z]* COUNC[A-Z]*)\b")
_YEAR = re.compile(r"(?:(?<![0-9])(20[0-9]{2}|19[0-9]{2})(?![0-9])|['’]([0-9]{2})(?![0-9]))")


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance with neighbouring swaps (one edit each), most + 1 where it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Words as a corpus uses them: those common in names of organisations, those that stand as given names, and short forms of common words."""

    common: frozenset[str] = frozenset()
    given: frozenset[str] = frozenset()
    alias: dict[str, str] = field(default_factory=dict)
    used: frozenset[str] = frozenset()  # the common words that the corpus itself has

    @classmethod
    def of(cls, counts: dict[str, int], given: frozenset[str] = frozenset(), seeds: frozenset[str] = frozenset()) -> Vocabulary:
        """From the common words with the number of places that know them, and words that are common anyway; one that shortens or misses a letter of a better known one stands for it."""
        whole = cls(frozenset(counts) | seeds, used=frozenset(counts))
        alias: dict[str, str] = {}
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            better = {c for c in (alias.get(c, c) for c in whole.longer(w)) if counts.get(c, 0) >= counts[w] or c in seeds and not _vowels(w)}
            if one := whole.only(better):
                alias[w] = one
        return cls(whole.common - set(alias), given, alias, whole.used)

    def only(self, words: set[str]) -> str | None:
        """The single word of a set, or the single one that the corpus has."""
        few = words if len(words) == 1 else words & self.used
        return next(iter(few)) if len(few) == 1 else None

    @cached_property
    def rests(self) -> dict[str, list[str]]:
        """The common words and their short forms by what is left of them after deleting one letter, or up to two of eight and more."""
        found: dict[str, list[str]] = {}
        for w in sorted([*self.common, *self.alias]):
            for r in _rests(w, 2 if len(w) >= 8 else 1):
                found.setdefault(r, []).append(w)
        return found

    @cached_property
    def ends(self) -> dict[str, list[str]]:
        """The common words by their first letter and last consonant."""
        found: dict[str, list[str]] = {}
        for w in sorted(self.common):
            found.setdefault(_ends(w), []).append(w)
        return found

    def longer(self, word: str) -> set[str]:
        """The common words that a word shortens, or misses one inner vowel of."""
        dropped = {c for c in self.rests.get(word, ()) if len(word) >= 5 and len(c) == len(word) + 1 and c[0] == word[0] and c[-1] == word[-1] and _vowels(c) > _vowels(word)}
        return dropped | {c for c in self.ends.get(_ends(word), ()) if shortens(word, c)}


def _ends(word: str) -> str:
    return word[:1] + word[1:].rstrip("S").rstrip("AEIOUY")[-1:]


def _rests(word: str, most: int) -> set[str]:
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def _vowels(word: str) -> int:
    return sum(ch in "AEIOU" for ch in word)


def shortens(short: str, word: str) -> bool:
    """Whether short is a short form of word.

    Two letters or more are left out; the first letter, the last consonant (but for a
    plural's S) and the order are kept; either no vowel is kept, or two fifths of the
    letters and more of the consonants than of the vowels. A word's own end is none.
    """
    if len(short) < 3 or len(word) < len(short) + 2 or _ends(short) != _ends(word) or word.endswith(short):
        return False
    few, all_vowels = _vowels(short), _vowels(word)
    if few and (len(short) < 0.4 * len(word) or (len(short) - few) * all_vowels <= few * (len(word) - all_vowels)):
        return False
    letters = iter(word)
    return all(ch in letters for ch in (short[:-1] if short[-1] == "S" != word[-1] else short))


def misspelt(counts: dict[str, int], times: int = 10) -> set[str]:
    """Words that are one edit from a word with ``times`` their count, found through what is left after deleting a letter."""
    near: dict[str, list[str]] = {}
    for w in counts:
        for r in _rests(w, 1):
            near.setdefault(r, []).append(w)
    return {w for w, n in counts.items() if any(counts[x] >= times * n and distance(w, x, 1) == 1 for r in _rests(w, 1) for x in near[r])}


@lru_cache(maxsize=1)
def _formal_rests() -> dict[str, list[str]]:
    """The known given names by what is left of them after deleting up to two letters."""
    found: dict[str, list[str]] = {}
    for n in FORMAL:
        for r in _rests(n, 2):
            found.setdefault(r, []).append(n)
    return found


@lru_cache(maxsize=50_000)
def formal_names(token: str, v: Vocabulary = Vocabulary()) -> frozenset[str]:
    """The given names a token may stand for: itself or by its everyday form, with one or two typos in longer ones; a name that only the corpus knows stands for itself."""
    if token in FORMAL:
        return FORMAL[token]
    if token in v.given:
        return frozenset([token])
    if len(token) >= 4:
        near = [(distance(token, n, 2), n) for n in {n for r in _rests(token, 2 if len(token) >= 6 else 1) for n in _formal_rests().get(r, ())}]
        best = min((d for d, _ in near), default=9)
        if best == 1 or best == 2 and len(token) >= 6:
            return frozenset().union(*(FORMAL[n] for d, n in near if d == best))
    return frozenset()


def plain(text: str | None) -> str:
    """Upper case without accents; a zero or one inside a word is the letter it was scanned from."""
    t = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().upper() if not (text or "").isascii() else (text or "").upper()
    return t


@dataclass
class Name:
    """kind is P (person), C (campaign) or O (organisation)."""

    kind: str = "O"
    heads: list[str] = field(default_factory=list)  # surname, or the words that make the name special
    given: list[str] = field(default_factory=list)  # given names as written
    formal: list[str] = field(default_factory=list)  # what they may stand for
    initials: str = ""
    office: str = ""
    year: str = ""
    words: list[str] = field(default_factory=list)  # canonical words in order of the alphabet
    numbers: str = ""


def town_form(city: str | None) -> str:
    words = re.findall(r"[A-Z0-9]+", plain(city))
    return " ".join(TOWN.get(w, w) for w in words)


def same_town(a: str, b: str) -> bool:
    """Whether two town forms are one town with at most a typo or two; North X and South X, Port X and Fort X are not."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if any(u in _PARTS and v in _PARTS and u != v for u, v in ((x[0], y[0]), (x[-1], y[-1]))):
        return False
    most = 2 if min(len(a), len(b)) >= 8 else 1
    return distance(a, b, most) <= most


def state_form(state: str | None) -> str:
    s = re.sub(r"[^A-Z]", "", plain(state))
    return STATES.get(s, s if len(s) == 2 else "")


def zip_form(code: str | None) -> str:
    m = re.match(r"\s*([0-9]{5})", code or "")
    return m.group(1) if m else ""


def _tokens(text: str) -> list[str]:
    return re.findall(r"[A-Z0-9]+", re.sub(r"(?<=[A-Z])\.(?=[A-Z]\.)|(?<=[A-Z])['’](?=[A-Z])|(?<=\b[A-Z]\.[A-Z])\.", "", text))


def _unscan(word: str) -> str:
    """Digits between letters as the letters they were scanned from."""
    if re.search(r"[A-Z]", word) and re.search(r"[0-9]", word):
        return word.translate(str.maketrans("0135", "OIES"))
    return word


def person(last: str, first: str | None, v: Vocabulary = Vocabulary()) -> Name:
    """A person from a family-name field and a given-name field, which may be swapped or share one field."""
    quoted = re.findall(r"[\"“(]([A-Z ]+)[\"”)]", f"{first or ''} {last}")
    strip = lambda t: re.sub(r"[\"“(][A-Z ]*[\"”)]", " ", t)
    dropped = set(TITLES)
    if first is not None and re.search("[A-Z]", first):
        left = [_unscan(t) for t in _tokens(re.sub(r"[-'’]", "", strip(last))) if t not in dropped]
        right = [_unscan(t) for t in _tokens(re.sub(r"[-'’]", "", strip(first))) if t not in dropped]
        long_left, long_right = [t for t in left if len(t) > 1], [t for t in right if len(t) > 1]
        if len(long_left) == 1 and (long_left[0] in FORMAL or long_left[0] in v.given) and long_right and not any(formal_names(t, v) for t in long_right):
            left, right = right, left
    else:
        text = strip(last)
        if "," in text:
            a, _, b = text.partition(",")
            ta = [_unscan(t) for t in _tokens(re.sub(r"[-'’]", "", a)) if t not in dropped]
            tb = [_unscan(t) for t in _tokens(re.sub(r"[-'’]", "", b)) if t not in dropped]
            if not tb:
                return _from_words(ta, quoted, v)
            left, right = ta, tb
            if len(left) == 1 and (left[0] in FORMAL or left[0] in v.given) and not any(formal_names(t, v) for t in right if len(t) > 1):
                left, right = right, left
        else:
            return _from_words([_unscan(t) for t in _tokens(re.sub(r"[-'’]", "", text)) if t not in dropped], quoted, v)
    surname = "".join(t for t in left if len(t) > 1) or "".join(left)
    extra = [t for t in left if len(t) == 1 and surname != t]
    return _person(surname, right + extra, quoted, v)


def _from_words(words: list[str], quoted: list[str], v: Vocabulary) -> Name:
    """Given and family name from words in either order: initials and known given names apart, the rest is the family name."""
    known = [i for i, w in enumerate(words) if len(w) > 1 and formal_names(w, v)]
    at = known[0] if known else 0
    rest = [w for i, w in enumerate(words) if i != at and len(w) > 1]
    first = [w for i, w in enumerate(words) if i == at or len(w) == 1]
    if not rest:
        return _person("".join(words), [], quoted, v)
    return _person("".join(rest), first, quoted, v)


def _person(surname: str, first: list[str], quoted: list[str], v: Vocabulary) -> Name:
    long = [t for t in first if len(t) > 1]
    initials = "".join(t for t in first if len(t) == 1)
    given: list[str] = []
    if len(long) > 1 and not formal_names(long[0], v) and formal_names("".join(long), v):
        given = ["".join(long)]  # a blank inside the name
    elif len(long) == 1 and len(long[0]) == 2 and not formal_names(long[0], v) and not re.search("[AEIOUY]", long[0]):
        initials = long[0] + initials
    else:
        given = long[:1]
        initials += "".join(t[0] for t in long[1:])
    formal = sorted(frozenset().union(*(formal_names(t, v) for t in given + [q.replace(" ", "") for q in quoted]))) if given or quoted else []
    if given and formal_names(given[0], v) and quoted:
        both = formal_names(given[0], v) & frozenset().union(*(formal_names(q, v) for q in quoted))
        formal = sorted(both or formal_names(given[0], v))
    return Name("P", [surname] if surname else [], given, formal, initials)


def campaign(text: str, v: Vocabulary = Vocabulary()) -> Name | None:
    """A candidate's committee: office, year, family name and, where written, given name; None when it is none."""
    year = _YEAR.search(text)
    office = _OFFICE.search(re.sub(r"\s+", " ", text))
    if not office or not (year or re.search(r"\b(FOR|4|ELECT|FRIENDS)\b", text)):
        return None
    o = office.group(1)
    o = OFFICE_OF.get(o, "CITY COUNCIL" if o.startswith("CIT") else o)
    rest = re.sub(r"\s+", " ", text).replace(office.group(0), " ", 1)
    y = ""
    if year:
        y = year.group(1) or "20" + year.group(2)
        rest = rest.replace(year.group(0), " ", 1)
    rest = re.sub(r"[\"“(][A-Z ]*[\"”)]", " ", rest)
    words = [_unscan(t) for t in _tokens(re.sub(r"(?<=[A-Z])[-'’](?=[A-Z])", "", rest.replace("RE-ELECT", " ")))]
    words = ["COMMITTEE" if WORDS.get(t) == "COMMITTEE" or len(t) >= 4 and shortens(t, "COMMITTEE") else t for t in words]
    words = [t for t in words if t not in CAMPAIGN and t != "4" and not t.isdigit() and not any(len(t) >= 5 and distance(t, c, 1) <= 1 for c in ("COMMITTEE", "FRIENDS", "ELECT"))]
    known = [i for i, t in enumerate(words) if len(t) > 1 and formal_names(t, v)]
    if len([t for t in words if len(t) > 1]) <= 1:
        known = []
    given = [words[known[0]]] if known else []
    surname = "".join(t for i, t in enumerate(words) if len(t) > 1 and not (known and i == known[0]))
    initials = "".join(t for t in words if len(t) == 1)
    if not surname:
        return None
    return Name("C", [surname], given, sorted(formal_names(given[0], v)) if given else [], initials, o, y)


@lru_cache(maxsize=100_000)
def _corrected(word: str, v: Vocabulary) -> str:
    """The common word that a word is a typo or a short form of; else the word itself."""
    for most, least in ((1, 3), (2, 8)):
        if len(word) >= least:
            near = {c for r in _rests(word, most) for c in v.rests.get(r, ()) if len(c) >= max(least, 4 if len(word) < 5 else 3) and abs(len(c) - len(word)) <= most and distance(word, c, most) <= most}
            near = near & v.common or near
            if near:
                return min(v.alias.get(c, c) for c in near)
        if least == 3:
            short = [k for k in WORDS if len(k) >= 4 and abs(len(k) - len(word)) <= 1 and distance(word, k, 1) <= 1]
            if short:
                return min(WORDS[k] for k in short)
            if whole := v.only(v.longer(word)):
                return whole
    return word


def organisation(text: str, v: Vocabulary) -> Name:
    """Canonical words of an organisation's name; heads are the words that are not common in the corpus."""
    text = re.sub(r"\([A-Z0-9. ]{2,12}\)", " ", text)
    text = re.sub(r"\bP\.\s?A\.\s?C\.?|\bPAC\b", " POLITICAL ACTION COMMITTEE ", text)
    text = re.sub(r"\bASS['’]N\b", "ASSOCIATION", text).replace("&", " AND ").replace("+", " AND ")
    text = re.sub(r"(?<=[A-Z])['’-](?=[A-Z])", "", text)
    words = [WORDS.get(t) or v.alias.get(t, t) for t in map(_unscan, _tokens(text))]
    joined: list[str] = []
    for w in words:
        if joined and joined[-1] + w in v.common:
            joined[-1] += w
        else:
            joined.append(w)
    fixed: list[str] = []
    for w in joined:
        if w not in v.common and not w.isdigit() and len(w) >= 3:
            w = _corrected(w, v)
        if w not in DROPPED:
            fixed.append(w)
    numbers = " ".join(sorted(w for w in fixed if w.isdigit()))
    special = [w for w in fixed if w not in v.common and not w.isdigit()]
    if len(special) == 2 and fixed.index(special[1]) - fixed.index(special[0]) == 1:
        special.append("".join(special))  # perhaps a blank inside the word
    rest = sorted(set(w for w in fixed if w in v.common))
    return Name("O", special or ["".join(sorted(fixed))], words=rest, numbers=numbers)


_ORGANISED = re.compile(r"\b(COMMITTEE|CMTE|COMTE|PAC|P\.A\.C|POLITICAL|ASSOCIATION|ASSN|ASSOC|INC|INCORPORATED|COMPANY|CO|UNION|LOCAL|COUNCIL|GUILD|FEDERATION|ALLIANCE|BROTHERHOOD)\b")


def parse(last: str | None, first: str | None, kind: str | None, v: Vocabulary) -> Name:
    """The parts of a name; kind (IND, COM, OTH or null) is only a hint."""
    last, first = plain(last), None if first is None else plain(first)
    if first is not None and re.search("[A-Z]", first) and not _ORGANISED.search(last):
        return person(last, first, v)
    text = f"{last} {first or ''}".strip()
    found = None if _ORGANISED.search(text) and re.search(r"\bPOL|\bP\.?A\.?C\b|\bLOCAL\b|\bCONTRIB", text) else campaign(text, v)
    if found:
        return found
    words = _tokens(re.sub(r"[-'’]", "", text))
    long = [w for w in words if len(w) > 1 and w not in TITLES]
    if not _ORGANISED.search(text) and 1 < len(words) <= 5 and len(long) <= 3 and any(formal_names(w, v) for w in long) and not any(w in v.common or w in v.alias for w in long if w not in FORMAL):
        return person(text, None, v)
    if kind == "IND" and "," in text and len(long) <= 3 and not any(w in v.common or w in v.alias for w in long):
        return person(text, None, v)
    return organisation(text, v)
