"""Variant spellings of one person, campaign or organisation: canonical rewritings, equi-join, verification, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.names import DROPPED, FORMAL, OFFICE_OF, TITLES, TRADES, WORDS, Vocabulary, distance, misspelt, parse, same_town, state_form, town_form, zip_form
from tallyforge.operators.components import connected_components
from tallyforge.session import checkpointed

#: A word belongs to a vocabulary when it is used so in at least so many places, whatever the size of the table.
KNOWN_PLACES = 5
#: A common word stands beside a given name, or as one, in less than this share of its uses; a family's name does not.
MOST_PERSONAL = 0.1
#: Share of a rewriting's rows that must lie in one place for a row without a place to belong there.
SURE = 0.9
#: Rows from which a form's group is joined in several tasks, and in how many.
SALT_FROM, SALTS = 1024, 16

#: Words that one task takes letters from.
WORDS_PER_TASK = 10_000

PARSED = "pid long, kind string, head string, heads array<string>, given string, formal array<string>, initials string, office string, year string, words array<string>, numbers string, town string, state string, zip string, members long"
PARTS = ["kind", "heads", "given", "formal", "initials", "office", "year", "words", "numbers", "town", "state", "zip"]


def vocabulary(rows: DataFrame, last: str, first: str | None, town: str, code: str | None) -> Vocabulary:
    """The words that names of organisations have in common (trades, legal forms and the like), and the given names in use.

    A word is common when it is known in KNOWN_PLACES places (first three digits of the
    code, or towns where the table has no codes) and stands in a name with a given name,
    or as one, in less than MOST_PERSONAL of its uses: SMITH is known everywhere, but
    mostly beside given names. A given name is known in as many places as one. Neither
    threshold depends on the size of the table. Counted over all rows with map-side
    combining; what is collected is a vocabulary and not data.
    """
    words = lambda c: F.array_distinct(F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]+", " "), " "))
    beside = F.col(first) if first else F.lit(None).cast("string")
    place = F.regexp_extract(F.coalesce(F.col(code).cast("string"), F.lit("")), "^\\s*([0-9]{3})[0-9]{2}", 1) if code else F.upper(F.trim(F.coalesce(F.col(town), F.lit(""))))
    named = F.coalesce(beside.rlike("[A-Za-z]"), F.lit(False))
    uses = F.concat(F.transform(words(F.col(last)), lambda w: F.struct(w.alias("w"), named.alias("personal"), F.lit(False).alias("given"))), F.transform(words(beside), lambda w: F.struct(w.alias("w"), F.lit(True).alias("personal"), F.lit(True).alias("given"))))
    per = rows.select(place.alias("place"), F.explode(uses).alias("u")).where("length(u.w) > 1").groupBy("u.w", "u.personal", "u.given", "place").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("place") != ""
    places = lambda c: F.count_distinct(F.when(c & known, F.col("place")))
    share = F.sum(F.when(F.col("personal"), F.col("n")).otherwise(0)) / F.sum("n")
    counted = per.groupBy("w").agg(places(~F.col("personal")).alias("common"), places(F.col("given")).alias("given"), share.alias("share"))
    counts, given = {}, {}
    for r in counted.where(((F.col("common") >= KNOWN_PLACES) & (F.col("share") < MOST_PERSONAL)) | (F.col("given") >= KNOWN_PLACES)).toLocalIterator():
        if r["common"] >= KNOWN_PLACES and r["share"] < MOST_PERSONAL:
            counts[r["w"]] = r["common"]
        elif len(r["w"]) > 2 and r["w"] not in TITLES:
            given[r["w"]] = r["given"]
    plain_words = lambda ws: {w for w in ws if w not in FORMAL and w not in WORDS}
    seeds = plain_words([*TRADES, *WORDS.values(), *DROPPED, *[w for o in OFFICE_OF.values() for w in o.split()]])
    return Vocabulary.of({w: counts[w] for w in plain_words(counts)}, frozenset(given.keys() - FORMAL.keys() - misspelt(given)), frozenset(seeds))


def profiles(rows: DataFrame, v: Vocabulary, *, row_id: str, last: str, first: str | None, kind: str | None, town: str, state: str, code: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, members): the distinct parsed names with place, and (pid, id) of the rows behind each.

    Rows that agree in everything compared become one profile, so that any number of
    copies costs no more than one; pid is the smallest id among them.
    """
    cols = [F.col(c).cast("string").alias(a) if c else F.lit(None).cast("string").alias(a) for c, a in ((last, "last"), (first, "first"), (kind, "kind"), (town, "town"), (state, "state"), (code, "code"))]
    raw = rows.select(F.col(row_id).cast("long").alias("id"), *cols).where("id is not null and last is not null")
    distinct = raw.groupBy("last", "first", "kind", "town", "state", "code").agg(F.min("id").alias("rid"))

    def take_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                n = parse(r.last, r.first, r.kind, v)
                head = n.heads[0] if n.heads else ""
                out.append((r.rid, n.kind, head, n.heads, n.given[0] if n.given else "", n.formal, n.initials, n.office, n.year, n.words, n.numbers, town_form(r.town), state_form(r.state), zip_form(r.code)))
            yield pd.DataFrame(out, columns=["rid", "kind", "head", "heads", "given", "formal", "initials", "office", "year", "words", "numbers", "town", "state", "zip"])

    schema = PARSED.replace("pid long", "rid long").replace(", members long", "")
    parsed = checkpointed(with_towns_filled(checkpointed(distinct.mapInPandas(take_apart, schema))))
    parts = [c.split()[0] for c in schema.split(", ")[1:]]
    whole = parsed.groupBy(*parts).agg(F.min("rid").alias("pid"), F.count(F.lit(1)).alias("members"))
    of_raw = parsed.join(whole.select("pid", *parts), parts).select("rid", "pid")
    keys = ["last", "first", "kind", "town", "state", "code"]
    same = [raw[k].eqNullSafe(distinct[k]) for k in keys]
    members = raw.join(distinct, same).select("id", "rid").join(of_raw, "rid").select("pid", "id")
    return checkpointed(whole.select("pid", *parts, "members")), checkpointed(members)


def with_towns_filled(parsed: DataFrame) -> DataFrame:
    """Missing towns from the code: the town most rows with the code have, else with its first four digits."""
    known = parsed.where("town <> '' and zip <> ''")

    def usual(digits: int, name: str) -> DataFrame:
        counts = known.groupBy(F.substring("zip", 1, digits).alias(name), "town").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(name).agg(F.max(F.struct("n", "town")).alias("m"), F.sum("n").alias("all")).where("m.n * 2 > all").select(name, F.col("m.town").alias(f"{name}_town"))

    lost = parsed.where("town = '' and zip <> ''").withColumn("z4", F.substring("zip", 1, 4)).join(usual(5, "z5"), F.col("zip") == F.col("z5"), "left").join(usual(4, "z4"), "z4", "left")
    filled = lost.withColumn("town", F.coalesce("z5_town", "z4_town", "town")).select(*parsed.columns)
    return parsed.where("not (town = '' and zip <> '')").unionByName(filled)


def respelt(words: DataFrame, most: Column, same: Callable[[str, str], bool]) -> DataFrame:
    """(word, key): every word's own key, and those of the more frequent words it may be a respelling of; words is (word, n).

    Two words that ``same`` accepts share a key: of the two, the rarer has the other's.
    Candidates share a text left by deleting at most ``most`` letters (2 at most) from
    each, which all words within that many edits or swaps do; ``same`` verifies them.
    """
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    w = F.col("word")
    twice = F.when(F.col("most") > 1, F.flatten(F.transform(without(w), without))).otherwise(F.array().cast("array<string>"))
    left = F.array_distinct(F.concat(F.array(w), without(w), twice))
    tasks = max(1, -(-words.count() // WORDS_PER_TASK))  # each word becomes about a hundred rows
    cut = words.repartition(tasks, "word").withColumn("most", most).where("most > 0 and length(word) > 1").select(F.struct("n", "word").alias("w"), F.explode(left).alias("cut")).select("w", F.xxhash64("cut").alias("cut"))
    cut = checkpointed(cut)
    near = cut.alias("x").join(cut.alias("y"), "cut").where("x.w < y.w and abs(length(x.w.word) - length(y.w.word)) <= 2").select(F.col("x.w.word").alias("word"), F.col("y.w.word").alias("key")).distinct()

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[same(x, y) for x, y in zip(f["word"], f["key"])]]

    return words.select("word", F.col("word").alias("key")).unionByName(near.mapInPandas(verify, "word string, key string"))


def _near_lost_zips(p: DataFrame) -> DataFrame:
    """(zip, key): for every code, the codes of rows without a town that place_agreement takes for near, itself included."""
    close = F.array(F.floor(F.col("zip").cast("int") / 45).cast("string"), (F.floor(F.col("zip").cast("int") / 45) + 1).cast("string"))
    masked = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.substring("zip", F.lit(1), i - 1), F.lit("_"), F.substring(F.col("zip"), i + 1, F.lit(5))))
    swapped = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.substring("zip", F.lit(1), i - 1), F.array_join(F.array_sort(F.split(F.substring(F.col("zip"), i, F.lit(2)), "")), ""), F.lit("~"), F.substring(F.col("zip"), i + 2, F.lit(5))))
    marks = lambda df: df.distinct().withColumn("mark", F.explode(F.concat(close, masked, swapped)))
    lost = marks(p.where("zip <> '' and town = ''").select("zip")).select(F.col("zip").alias("key"), "mark")
    return marks(p.where("zip <> ''").select("zip")).join(lost, "mark").select("zip", "key").distinct()


def _beside() -> Column:
    """What must agree exactly beside the name: each given name it may stand for; office and year; other words and numbers."""
    given = F.when(F.size("formal") > 0, F.col("formal")).when(F.length("given") > 0, F.array("given")).otherwise(F.array().cast("array<string>"))
    return (
        F.when(F.col("kind") == "P", F.transform(given, lambda f: F.concat(F.lit("g:"), f)))
        .when(F.col("kind") == "C", F.array(F.concat(F.lit("o:"), F.col("office"), F.lit(" "), F.col("year"))))
        .otherwise(F.array(F.concat(F.lit("w:"), F.array_join("words", " "), F.lit(" "), F.col("numbers"))))
    )


def _initials() -> Column:
    """The first letters a person's given name may have."""
    initial = F.when(F.length("given") > 0, F.array(F.substring("given", 1, 1))).when(F.length("initials") > 0, F.array(F.substring("initials", 1, 1))).otherwise(F.array())
    letters = F.array_distinct(F.concat(initial, F.transform("formal", lambda f: F.substring(f, 1, 1))))
    return F.when(F.col("kind") == "P", F.transform(letters, lambda f: F.concat(F.lit("i:"), f))).otherwise(F.array().cast("array<string>"))


def _needed() -> Column:
    """Of what stands beside the name, parts of which all that same_entity accepts share one; none for a person without given name."""
    # a given name that is in no list is compared by edits, which leave one of its first letters among those of the other
    begin = F.substring("given", F.lit(1), F.when(F.length("given") >= 6, 3).otherwise(2))
    unlisted = (F.length("given") > 0) & (~F.col("given").isin(*FORMAL) | (F.length("given") <= 4))
    begins = F.when(unlisted, F.transform(F.filter(F.split(begin, ""), lambda x: x != ""), lambda x: F.concat(F.lit("b:"), x))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("kind") == "P", F.concat(_initials(), begins)).when(F.col("kind") == "C", F.array(F.concat(F.lit("o:"), F.col("office")))).otherwise(_beside())


def _form(letter: str, *rest) -> Column:
    return F.concat_ws("|", F.col("kind"), F.lit(letter), *rest)


@dataclass(frozen=True)
class Keys:
    """Keys that words share when one may be a respelling of the other (see respelt): (word, key) of names and towns, (zip, key) of codes near rows without town."""

    heads: DataFrame
    towns: DataFrame
    zips: DataFrame


def shared_keys(*profiles: DataFrame) -> Keys:
    """The keys of all names and towns of the profiles together."""
    seen = profiles[0].select("heads", "town", "zip")
    for p in profiles[1:]:
        seen = seen.unionByName(p.select("heads", "town", "zip"))
    counted = lambda df: checkpointed(df.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    long = F.length("word")
    heads = respelt(counted(seen.select(F.explode("heads").alias("word"))), F.when(long >= 6, 2).when(long >= 4, 1).otherwise(0), lambda x, y: distance(x, y, _tolerated(x, y)) <= _tolerated(x, y))
    towns = respelt(counted(seen.where("town <> ''").select(F.col("town").alias("word"))), F.when(long >= 8, 2).otherwise(1), same_town)
    listed = lambda df, by, name: df.groupBy(F.col(by[0]).alias(by[1])).agg(F.collect_list("key").alias(name))
    return Keys(*[checkpointed(listed(df, by, name)) for df, by, name in ((heads, ("word", "head"), "heads"), (towns, ("word", "town"), "towns"), (_near_lost_zips(seen), ("zip", "zip"), "zips"))])


def placed_forms(p: DataFrame, keys: Keys) -> DataFrame:
    """(form, pid, asks): the rewritings of profiles with a place, such that all pairs that same_entity accepts there share one.

    A form is the name's key with one part of what must agree beside it, at a zip code
    (z), in a town (t), or near the code of a row without town (k). A person without
    given name may be anyone of that name at the same zip code: these forms (y) are
    asked for by such rows alone, and no two others meet through them, so that a
    frequent family name is paired within given names only.
    """
    parts = p.where("town <> '' or zip <> ''").select("pid", "kind", "zip", "town", F.explode("heads").alias("head"), _needed().alias("needed"))
    parts = parts.join(keys.heads, "head").join(keys.towns, "town", "left").join(keys.zips, "zip", "left")
    none = F.array().cast("array<string>")
    names = F.flatten(F.transform("heads", lambda h: F.transform("needed", lambda b: F.concat_ws("|", h, b))))
    around = lambda letter, places: F.flatten(F.transform(F.coalesce(places, none), lambda t: F.transform(names, lambda x: _form(letter, t, x))))
    at_zip = F.when(F.col("zip") != "", F.transform(names, lambda x: _form("z", F.col("zip"), x))).otherwise(none)
    open_forms = F.when((F.col("zip") != "") & (F.col("kind") == "P"), F.transform("heads", lambda h: _form("y", F.col("zip"), h))).otherwise(none)
    forms = parts.select("pid", F.explode(F.concat(at_zip, around("t", F.col("towns")), around("k", F.col("zips")))).alias("form"), F.lit(True).alias("asks"))
    anyone = parts.select("pid", F.explode(open_forms).alias("form"), (F.size("needed") == 0).alias("asks"))
    asked = anyone.where("asks").select("form").distinct()
    return forms.unionByName(anyone.join(asked, "form", "left_semi")).distinct()


def free_forms(p: DataFrame, keys: Keys | None = None, whole: bool = False) -> DataFrame:
    """(form, pid): rewritings of names without their place.

    By default of the exact name, with what must agree beside it or with an initial (n).
    With keys, of all names within the tolerated edits: with a part of what must agree
    beside them (a), or with all of it when ``whole`` (f).
    """
    parts = F.array_distinct(F.concat(_beside(), _initials())) if keys is None else _beside() if whole else _needed()
    heads = p.select("pid", "kind", F.explode("heads").alias("head"), parts.alias("parts"))
    names = F.transform("parts", lambda b: _form("n", F.col("head"), b))
    if keys is not None:
        heads = heads.join(keys.heads, "head")
        names = F.flatten(F.transform("heads", lambda h: F.transform("parts", lambda b: _form("f" if whole else "a", h, b))))
    return heads.select("pid", F.explode(names).alias("form")).distinct()


def form_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b): profiles that share a form. Within one table a < b, and one of the two asks for the form.

    A form's group of more than SALT_FROM rows is joined in SALTS slices of its left
    side, so that a frequent form is no single task.
    """
    own = right is None
    right = left if own else right
    many = left.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_FROM).select("form", F.lit(True).alias("hot"))
    slots = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("pid"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    asked = left.where("asks") if own else left
    l = asked.join(many, "form", "left").select("form", F.col("pid").alias("a"), salt.alias("salt"))
    r = right.join(many, "form", "left").select("form", F.col("pid").alias("b"), (F.col("asks") if own else F.lit(False)).alias("both"), F.explode(slots).alias("salt"))
    pairs = l.join(r, ["form", "salt"])
    if own:
        pairs = pairs.where("a < b or (a > b and not both)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select("a", "b").distinct()


def placeless_pairs(p: DataFrame, keys: Keys) -> DataFrame:
    """(a, b, score), a < b: profiles whose place is unknown, or known by code only, with those they may belong to, scored by the rarity of what they share.

    A rewriting is the rarer the fewer places know it: its score at a place is the share
    of all rows with the rewriting (of those in the state that the row names, if any
    is known there) that lie there, and a pair's score is the best of the rewritings it shares, so that the
    rarest decides. Rewritings are those of the exact name, and of all names within the
    tolerated edits together with all that stands beside them. Only scores of SURE and more are formed, which at most one place of
    a rewriting can have: a name known in many places is joined with nothing. A
    rewriting that no row with a place has scores 1. Places are told apart by the first
    three digits of the code; a row without one has those most rows of its town have.
    """
    near = p.where("zip <> '' and town <> ''").groupBy("town", F.substring("zip", 1, 3).alias("z3")).agg(F.sum("members").alias("n"))
    usual = near.groupBy("town").agg(F.max(F.struct("n", "z3")).alias("m")).select("town", F.col("m.z3").alias("z3"))
    placed = p.join(usual, "town", "left").select("pid", "state", "members", F.when(F.col("zip") != "", F.substring("zip", 1, 3)).otherwise(F.col("z3")).alias("place"), (F.col("town") == "").alias("nowhere"))
    placed = checkpointed(placed.withColumn("lost", F.col("place").isNull() | F.col("nowhere")))
    forms = checkpointed(free_forms(p).unionByName(free_forms(p, keys, whole=True)))
    asked = forms.join(placed.where("lost").select("pid"), "pid", "left_semi").select("form").distinct()
    rows = checkpointed(forms.join(asked, "form", "left_semi").join(placed, "pid"))
    scopes = F.explode(F.array_distinct(F.array(F.lit("*"), F.when(F.col("state") != "", F.col("state")).otherwise(F.lit("*"))))).alias("scope")
    counts = rows.where("place is not null").select("form", "place", "members", scopes).groupBy("form", "scope", "place").agg(F.sum("members").alias("n"))
    best = counts.groupBy("form", "scope").agg(F.max(F.struct("n", "place")).alias("m"), F.sum("n").alias("all"))
    best = checkpointed(best.select("form", "scope", F.col("m.place").alias("best"), (F.col("m.n") / F.col("all")).alias("score")))
    known = best.select("form", F.col("scope").alias("state"), F.lit(True).alias("known"))
    asks = rows.where("lost").join(known, ["form", "state"], "left").select("form", F.col("pid").alias("a"), F.col("place").alias("at"), F.when(F.col("known"), F.col("state")).otherwise("*").alias("scope"))
    scored = rows.select("form", "pid", "place", scopes).join(best, ["form", "scope"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    answers = scored.where((F.col("score") >= SURE) & (F.col("place").isNull() | (F.col("place") == F.col("best")))).select("form", "scope", F.col("pid").alias("b"), "score", "best")
    pairs = asks.join(answers, ["form", "scope"]).where("a <> b and (at is null or best is null or at = best)")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


@dataclass(frozen=True)
class Side:
    """One side of a pair, as it comes from a row."""

    kind: str
    heads: tuple[str, ...]
    given: str
    formal: frozenset
    initials: str
    office: str
    year: str
    words: frozenset
    numbers: str
    town: str
    state: str
    zip: str


def _near_zip(a: str, b: str) -> bool:
    if a == b:
        return True
    diff = [i for i in range(5) if a[i] != b[i]]
    return len(diff) == 1 or len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]


def place_agreement(a: Side, b: Side) -> int:
    """2: same place and code; 1: same place; 0: cannot be told; -1: different places."""
    zips = bool(a.zip and b.zip)
    same_zip = zips and a.zip == b.zip
    if a.town and b.town:
        same = same_town(a.town, b.town)
        if same and a.town != b.town and zips and abs(int(a.zip) - int(b.zip)) > 60 and not _near_zip(a.zip, b.zip):
            same = False
        if same:
            return 2 if same_zip else 1
        return 2 if same_zip else -1
    if zips:
        if same_zip:
            return 2
        return 1 if abs(int(a.zip) - int(b.zip)) <= 45 or _near_zip(a.zip, b.zip) else -1
    if a.state and b.state and a.state != b.state:
        return -1
    return 0


def head_distance(a: Side, b: Side) -> int:
    """Edits between the family names or special words, 9 when they differ."""
    if a.kind == "O" and (len(a.heads) > 1 or len(b.heads) > 1):
        return _special_distance(a, b)
    x, y = a.heads[0] if a.heads else "", b.heads[0] if b.heads else ""
    most = _tolerated(x, y)
    d = distance(x, y, most)
    return d if d <= most else 9


def _tolerated(x: str, y: str) -> int:
    short = min(len(x), len(y))
    return 2 if short >= 6 else 1 if short >= 4 else 0


def _special_distance(a: Side, b: Side) -> int:
    """Edits between two lists of special words; a list of three ends with its first two written as one."""
    best = 9
    for x in (a.heads[-1:] if len(a.heads) != 2 else ()) or ():
        for y in (b.heads[-1:] if len(b.heads) != 2 else ()) or ():
            d = distance(x, y, _tolerated(x, y))
            best = min(best, d if d <= _tolerated(x, y) else 9)
    one, two = (list(s.heads[:2] if len(s.heads) == 3 and s.heads[2] == s.heads[0] + s.heads[1] else s.heads) for s in (a, b))
    few, many = sorted((one, two), key=len)
    total = 0
    for x in few:
        d, y = min(((distance(x, y, _tolerated(x, y)), y) for y in many), default=(9, ""))
        if d > _tolerated(x, y):
            return best
        total += d
        many.remove(y)
    return min(best, total if not many else 9)


def given_agreement(a: Side, b: Side) -> int:
    """2: same given name; 1: an initial that fits; 0: not given on a side; -1: different."""
    ia, ib = a.initials, b.initials
    if a.formal and b.formal:
        ok = bool(a.formal & b.formal)
        if not ok:
            return -1
        if ia and ib and ia[0] != ib[0]:
            return -1
        return 2
    if a.given and b.given and not (a.formal and b.formal):
        most = 2 if min(len(a.given), len(b.given)) >= 6 else 1
        if distance(a.given, b.given, most) <= most:
            return -1 if ia and ib and ia[0] != ib[0] else 2
        return -1
    if not (a.given or a.formal) and not (b.given or b.formal):
        if ia and ib:
            return 1 if ia[0] == ib[0] and (len(ia) < 2 or len(ib) < 2 or ia[1] == ib[1]) else -1
        return 0
    full, short = (a, b) if a.given or a.formal else (b, a)
    if not short.initials:
        return 0
    firsts = {f[0] for f in full.formal} | ({full.given[0]} if full.given else set())
    if short.initials[0] not in firsts:
        return -1
    if len(short.initials) > 1 and full.initials and short.initials[1] != full.initials[0]:
        return -1
    return 1


def same_entity(a: Side, b: Side, score: float) -> bool:
    """Whether two profiles denote one entity; score is that of placeless_pairs, which decides where the place cannot be told."""
    if a.kind != b.kind:
        return False
    place = place_agreement(a, b)
    if place < 0:
        return False
    heads = head_distance(a, b)
    if heads == 9:
        return False
    if place == 0 and (score < SURE or heads > 1):
        return False
    if a.kind == "P":
        given = given_agreement(a, b)
        if given < 0 or given == 0 and (place < 2 or heads):
            return False
        if given == 1:
            # an initial may be another member of the family: the codes must not speak against it
            if heads > 1 or a.zip and b.zip and not _near_zip(a.zip, b.zip):
                return False
        if heads == 3 and place < 2:
            return False
        return True
    if a.kind == "C":
        if a.office != b.office or a.year and b.year and a.year != b.year:
            return False
        if (a.given or a.initials) and (b.given or b.initials) and given_agreement(a, b) < 0:
            return False
        return True
    if a.numbers != b.numbers:
        return False
    gone = a.words ^ b.words
    return not gone


def sides(pairs: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """The pairs with the parts of both sides as structs sa and sb, without those whose words, numbers, office or year rule them out."""
    side = lambda df, x: df.select(F.col("pid").alias(x), F.struct(*PARTS).alias(f"s{x}"))
    wide = pairs.join(side(p, "a"), "a").join(side(q, "b"), "b").where("sa.kind = sb.kind")
    same = lambda c: F.col(f"sa.{c}") == F.col(f"sb.{c}")
    years = same("year") | (F.col("sa.year") == "") | (F.col("sb.year") == "")
    return wide.where(F.when(F.col("sa.kind") == "O", same("numbers") & same("words")).when(F.col("sa.kind") == "C", same("office") & years).otherwise(True))


def side_of(s: dict) -> Side:
    return Side(s["kind"], tuple(s["heads"]), s["given"], frozenset(s["formal"]), s["initials"], s["office"], s["year"], frozenset(s["words"]), s["numbers"], s["town"], s["state"], s["zip"])


def judged_pairs(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, score) that denote one entity."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [same_entity(side_of(x), side_of(y), s) for x, y, s in zip(f["sa"], f["sb"], f["score"])]
            yield f.loc[keep, ["a", "b"]]

    return sides(pairs, p, p).select("a", "b", "score", "sa", "sb").mapInPandas(judge, "a long, b long")


def linked_profiles(p: DataFrame, keys: Keys | None = None) -> DataFrame:
    """(a, b): the pairs of profiles that denote one entity; keys are those of p, or of p and others."""
    keys = keys or shared_keys(p)
    placed = form_pairs(checkpointed(placed_forms(p, keys))).withColumn("score", F.lit(0.0))
    return judged_pairs(placed.unionByName(placeless_pairs(p, keys)), p)


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, cid): connected profiles; cid is the smallest pid."""
    return connected_components(nodes.select(F.col("pid").alias("node")), edges).select(F.col("node").alias("pid"), F.col("component").alias("cid"))


def variant_clusters(rows: DataFrame, *, row_id: str, last: str, first: str | None, kind: str | None, town: str, state: str, code: str) -> DataFrame:
    """(id, cid): rows of names with the cluster of rows that denote the same entity; cid is its smallest id.

    Method: every name is taken apart (order of parts, titles, nicknames, initials,
    offices, legal forms, shortened words) and all its canonical rewritings are
    generated, with names and towns keyed so that all within the edits that
    verification tolerates meet; equal forms are joined, and a candidate pair is
    verified on all its parts. Where a row has no place, the rarity of the shared
    rewritings is its score and decides (see placeless_pairs). Linked rows form
    clusters. Rows that agree in all compared parts are one profile, so copies never
    multiply.

    Defined results: rows with null id or null ``last`` are left out; an empty table
    gives no rows; a row like no other is its own cluster; repeated ids count once
    per row; other columns are ignored, whatever their names.
    """
    v = vocabulary(rows, last, first, town, code)
    p, members = profiles(rows, v, row_id=row_id, last=last, first=first, kind=kind, town=town, state=state, code=code)
    c = clusters(p, checkpointed(linked_profiles(p)))
    return members.join(c, "pid").select("id", "cid")


def variant_pairs(c: DataFrame) -> DataFrame:
    """(id_a, id_b), a < b: all pairs of rows in one cluster; the size of the result is the size asked for."""
    slice_of = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    big = c.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1000").select("cid", F.lit(True).alias("hot"))
    l = c.join(big, "cid", "left").select("cid", F.col("id").alias("id_a"), F.when(F.col("hot"), slice_of).otherwise(F.lit(0)).alias("salt"))
    r = c.join(big, "cid", "left").select("cid", F.col("id").alias("id_b"), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return l.join(r, ["cid", "salt"]).where("id_a < id_b").select("id_a", "id_b")
