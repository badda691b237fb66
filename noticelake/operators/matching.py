"""Matching every profile with every notice in one plan.

Hard filters pick up to 500 newest candidates per user; a vector arm and a
keyword arm rank them; reciprocal rank fusion joins the two under a floor
relative to the user's own best similarity.

Candidates by a threshold, without all pairs. Joining users with every notice they may
bid on and keeping 500 afterwards would emit users x notices rows. Instead notices are
first cut to the newest few per *cell* (district, nature, method and magnitude of the
security, each also as a wildcard), which bounds that side by the number of cells whatever
the corpus size, and a user joins only the cells of the profile. The first row beyond a
cell's cut takes part as a mark: what ranks above all marks of a user is certain, so a
user without a mark among the first 500 is *settled*. The others (narrow money
bounds, long histories) go into another round, with cells cut later by a factor, until
nobody is left; the answer is exact for everyone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticelake.functions.text import is_keyword, tokens
from noticelake.functions.vectors import cosine_similarity
from noticelake.operators.embedding import profile_texts
from noticelake.operators.filters import matchable, timestamp
from noticelake.operators.search import document
from noticelake.session import written

CANDIDATE_LIMIT, ARM_LIMIT, MATCH_LIMIT, KEYWORD_LIMIT = 500, 100, 50, 12
# Fusion damping, relative floor and its absolute backstop.
RRF_K, RELATIVE_FLOOR, ABSOLUTE_FLOOR = 60, 0.6, 0.15

WORD_SALTS = CLASS_SALTS = 16

PAIR = ["user_id", "notice_id"]
CELL = ["c_district", "c_nature", "c_method"]
CONSTRAINTS = ["district_names", "procurement_natures", "procurement_methods", "min_security", "max_security"]
# Securities of a cell lie within a factor of 8, so that money bounds exclude whole cells.
AMOUNT_BASE, AMOUNTS = 8, 20
# Values in cells start with "=", so no value of the data is one of these.
ANY = "*"        # wildcard of a cell
UNKNOWN = "?"    # district not known yet: passes every district list


# ------------------------------------------------------------ hard filters

def _recency() -> Column:
    """Sorts newest first, undated last, ties by id."""
    newest = F.coalesce(-F.unix_micros("published_at"), F.lit(9223372036854775807).cast("long"))
    return F.struct(newest.alias("age"), F.col("notice_id").alias("id"))


def _notice_rows(notices: DataFrame, as_of: str) -> DataFrame:
    return (notices.filter(matchable(timestamp(as_of)))
            .select(F.col("id").alias("notice_id"), "published_at", "tender_security",
                    F.coalesce(_value("district"), F.lit(UNKNOWN)).alias("c_district"),
                    _value("procurement_nature").alias("c_nature"),
                    _value("procurement_method").alias("c_method"))
            .withColumn("recency", _recency()).drop("published_at"))


def _value(c: Column | str) -> Column:
    return F.concat(F.lit("="), c)


def _notice_cells(rows: DataFrame) -> DataFrame:
    """Each notice in its eight cells: every dimension as itself and as ANY."""
    for c in CELL:
        rows = rows.withColumn(c, F.explode(F.array(F.col(c), F.lit(ANY))))
    return rows.dropna(subset=CELL)


def _user_cells(profiles: DataFrame) -> DataFrame:
    """The cells whose union is the user's constraint; ANY where there is none.

    Cells of one user never share a notice, so no duplicates arise."""
    def values(column: str, *extra: str) -> Column:
        listed = F.transform(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))), _value)
        some = F.array_union(listed, F.array(*map(F.lit, extra))) if extra else listed
        return F.when(F.size(listed) > 0, some).otherwise(F.array(F.lit(ANY)))

    return (profiles.select("user_id", "min_security", "max_security",
                            F.explode(values("district_names", UNKNOWN)).alias("c_district"),
                            "procurement_natures", "procurement_methods")
            .withColumn("c_nature", F.explode(values("procurement_natures")))
            .withColumn("c_method", F.explode(values("procurement_methods")))
            .select("user_id", "min_security", "max_security", *CELL))


def _money_bounds() -> Column:
    known = F.col("tender_security")
    low = F.coalesce(known >= F.col("min_security"), F.lit(True))
    high = F.coalesce(known <= F.col("max_security"), F.lit(True))
    return low & high


def _magnitude(amount: Column) -> Column:
    """Grows with the amount, and is one of ``AMOUNTS`` values; unknown if that is."""
    power = F.log(float(AMOUNT_BASE), F.greatest(amount.cast("double"), F.lit(1.0)))
    return F.when(amount.isNotNull(), F.least(F.floor(power), F.lit(AMOUNTS - 1)).cast("int"))


def _priced_rows(notices: DataFrame, as_of: str) -> DataFrame:
    """Notices with their own cell, also by the magnitude of their security or UNKNOWN."""
    own = F.coalesce(_value(_magnitude(F.col("tender_security")).cast("string")), F.lit(UNKNOWN))
    return _notice_rows(notices, as_of).withColumn("c_amount", own)


def _in_cells(priced: DataFrame) -> DataFrame:
    return _notice_cells(priced).withColumn("c_amount", F.explode(F.array("c_amount", F.lit(ANY))))


def _priced_cells(notices: DataFrame, as_of: str) -> DataFrame:
    return _in_cells(_priced_rows(notices, as_of))


def _cut(cells: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` of every cell with their rank."""
    w = Window.partitionBy(*CELL, "c_amount").orderBy("recency")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _priced_user_cells(profiles: DataFrame) -> DataFrame:
    """Users in their cells; money bounds pick the magnitudes between them."""
    low = F.coalesce(_magnitude(F.col("min_security")), F.lit(0))
    high = F.coalesce(_magnitude(F.col("max_security")), F.lit(AMOUNTS - 1))
    between = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda m: _value(m.cast("string")))).otherwise(
        F.array().cast("array<string>"))
    bounded = F.col("min_security").isNotNull() | F.col("max_security").isNotNull()
    return _user_cells(profiles).withColumn("c_amount", F.explode(
        F.when(bounded, F.array_append(between, UNKNOWN)).otherwise(F.array(F.lit(ANY)))))


def threshold_round(cells: DataFrame, users: DataFrame, seen: list[DataFrame], limit: int, cell_rows: int) -> DataFrame:
    """(user, notice, position, open) of the newest ``limit`` rows per user, the marks of
    cells cut at ``cell_rows`` among them. A user with a mark there is open: the rows
    below it are not certain. Pairs are pruned to the limit in every task before they
    are shuffled, and everything about a user happens in that one partition."""
    by = [*CELL, "c_amount"]
    top = _cut(cells, cell_rows + 1).withColumn("mark", F.col("rank") > cell_rows)
    pairs = top.join(users, by).filter(F.col("mark") | _money_bounds()).select(*PAIR, "recency", "mark")
    for s in seen:
        # A mark stays a mark if its pair was seen: its null meets nothing.
        pairs = pairs.withColumn("_unseen", F.when(~F.col("mark"), F.col("notice_id")))
        pairs = pairs.join(s.select("user_id", F.col("notice_id").alias("_unseen")), ["user_id", "_unseen"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("recency", F.desc("mark"))
    first = pairs.select(*PAIR, "recency", "mark").withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= limit)
    return first.withColumn("open", F.max("mark").over(Window.partitionBy("user_id"))).select(*PAIR, "position", "open")


def candidates(notices: DataFrame, profiles: DataFrame, as_of: str,
               seen: list[DataFrame] = (), limit: int = CANDIDATE_LIMIT,
               cell_rows: int | None = None, growth: int = 8) -> DataFrame:
    """Up to ``limit`` newest candidates per user, without the pairs in ``seen``
    (stored matches, given verdicts). ``cell_rows`` is the first round's cut per cell.

    Users of equal constraints have equal candidates but for their seen pairs: the rounds
    see one user of each such class (users of several profiles stand for themselves) and
    list more than ``limit``. Users who have seen none of their class's list get its head
    without a pair being shuffled; for the others the seen pairs leave it. Users left with too
    little of a full list get a list longer by a factor; the lists end with the notices."""
    classes = written(_classes(profiles, CONSTRAINTS))
    notice_rows = written(_priced_rows(notices, as_of))
    waiting, factor, parts = classes.select("user_id", "head").distinct(), 2 if seen else 1, []
    while True:
        heads = classes.filter("user_id = head").join(waiting.select("head").distinct(), "head", "left_semi")
        size = limit * factor
        lists = _newest(notice_rows, heads, size, (cell_rows or 2 * limit) * factor, growth)
        if not seen:
            return _to_members(lists, classes)
        met = written(_seen_in(lists, waiting, list(seen)))
        parts.append(_to_members(lists.filter(F.col("position") <= limit), waiting.join(
            met.select("user_id").distinct(), "user_id", "left_anti")))
        left, short = _without(lists, waiting, met, limit, size)
        parts.append(left)
        if short.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        waiting, factor = short, factor * growth


def _newest(rows: DataFrame, heads: DataFrame, limit: int, cut: int, growth: int) -> DataFrame:
    """The newest ``limit`` of every head. A round is written, so it is computed once whatever
    is made of it. Later rounds see the open users and the cells they use only; their number is
    bounded by the logarithm of the largest cell.

    What is beyond a notice's own cell's cut is beyond that of its wider cells too, so
    notices are cut before they are multiplied by their cells."""
    by, settled, users = [*CELL, "c_amount"], [], _priced_user_cells(heads)
    while True:
        cells = _in_cells(_cut(rows, cut + 1).drop("rank")).join(users.select(*by).distinct(), by, "left_semi")
        found = written(threshold_round(cells, users, [], limit, cut))
        settled.append(found.filter("NOT open").select(*PAIR, "position"))
        undecided = found.filter("open").select("user_id").distinct()
        if undecided.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        users, cut = users.join(undecided, "user_id", "left_semi"), cut * growth


def _seen_in(lists: DataFrame, members: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """The seen pairs of the members within the list of their head. Seen pairs of notices in
    nobody's list, nearly all, are dropped where they are read."""
    listed = lists.select("notice_id").distinct()
    pairs = reduce(DataFrame.unionByName, [s.select(*PAIR).join(listed, "notice_id", "left_semi") for s in seen])
    return pairs.distinct().join(members, "user_id").join(
        lists.select(F.col("user_id").alias("head"), "notice_id"), ["head", "notice_id"], "left_semi").select(*PAIR, "head")


def _without(lists: DataFrame, members: DataFrame, met: DataFrame, limit: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(candidates of the members who met some of their list before, members whose full list
    of ``size`` leaves them less than ``limit``)."""
    listed = lists.groupBy(F.col("user_id").alias("head")).agg(F.count("*").alias("listed"))
    short = written(met.groupBy("user_id", "head").agg(F.count("*").alias("met")).join(listed, "head").filter(
        (F.col("listed") >= size) & (F.col("listed") - F.col("met") < limit)).select("user_id", "head"))
    settled = met.select("user_id", "head").distinct().join(short, "user_id", "left_anti")
    pairs = settled.join(lists.select(F.col("user_id").alias("head"), "notice_id", "position"), "head").join(
        met.select(*PAIR), PAIR, "left_anti")
    left = pairs.select(*PAIR, F.row_number().over(Window.partitionBy("user_id").orderBy("position")).alias("position"))
    return left.filter(F.col("position") <= limit), short


def _classes(profiles: DataFrame, constraints: list[str]) -> DataFrame:
    """Profiles with the user who stands for theirs (``head``), of equal constraints."""
    rows = profiles.select("user_id", *constraints)
    alone = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1").select("user_id")
    rows = rows.join(alone.withColumn("_alone", F.lit(True)), "user_id", "left")
    own, shared = rows.filter("_alone").drop("_alone"), rows.filter("_alone IS NULL").drop("_alone")
    # Each class is a row of an aggregate, so a class of many users is no task's load.
    heads = shared.groupBy(*[F.col(c).alias(f"h_{c}") for c in constraints]).agg(F.min("user_id").alias("head"))
    same = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in constraints]
    return shared.join(heads, same).select("user_id", "head", *constraints).unionByName(
        own.select("user_id", F.col("user_id").alias("head"), *constraints))


def _to_members(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidates of heads for every user of their classes. A head's are one array, of
    ``limit`` at most; large classes are spread over ``CLASS_SALTS`` tasks."""
    salts = F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))
    lists = (pairs.groupBy(F.col("user_id").alias("head")).agg(F.collect_list(F.struct("notice_id", "position")).alias("found"))
             .withColumn("salt", F.explode(salts)))
    members = classes.select("user_id", "head").distinct().withColumn(
        "salt", F.pmod(F.xxhash64("user_id"), F.lit(CLASS_SALTS)).cast("int"))
    return members.join(lists, ["head", "salt"]).select("user_id", F.inline("found"))


def count_candidates(notices: DataFrame, profiles: DataFrame, as_of: str,
                     bucket: int = 10_000) -> DataFrame:
    """How many notices pass the hard filters per user, without forming pairs.

    Per cell, the number within money bounds is a difference of two cumulative
    counts: unknown + (amount <= max) - (amount < min). The distinct bounds are
    sorted among the distinct amounts, bucket by bucket, so that the work grows
    with notices + users and no cell is sorted in one piece."""
    cells = _notice_cells(_notice_rows(notices, as_of))
    users = _user_cells(profiles)
    totals = cells.groupBy(*CELL).agg(
        F.count_if(F.col("tender_security").isNull()).alias("unknown"),
        F.count("tender_security").alias("known"))
    money = "decimal(18,2)"
    # side 0 asks for amounts below a minimum, side 2 up to a maximum.
    bounds = [users.filter(F.col(c).isNotNull())
              .select(*CELL, F.col(c).cast(money).alias("at"), F.lit(side).alias("side")).distinct()
              .withColumn("n", F.lit(0).cast("long"))
              for c, side in (("min_security", 0), ("max_security", 2))]
    amounts = (cells.filter("tender_security IS NOT NULL")
               .groupBy(*CELL, F.col("tender_security").cast(money).alias("at"))
               .agg(F.lit(1).alias("side"), F.count("*").alias("n")))
    points = (amounts.unionByName(bounds[0]).unionByName(bounds[1])
              .withColumn("bucket", F.floor(F.col("at") / bucket)))
    w = Window.partitionBy(*CELL).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (points.groupBy(*CELL, "bucket").agg(F.sum("n").alias("n"))
               .select(*CELL, "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")))
    inside = Window.partitionBy(*CELL, "bucket").orderBy("at", "side").rowsBetween(
        Window.unboundedPreceding, 0)
    counted = (points.withColumn("within", F.sum("n").over(inside)).filter("side <> 1")
               .join(offsets, [*CELL, "bucket"])
               .select(*CELL, "at", "side", (F.col("before") + F.col("within")).alias("count")))

    def bound(side: int, column: str, name: str) -> DataFrame:
        return counted.filter(F.col("side") == side).select(
            *CELL, F.col("at").alias(column), F.col("count").alias(name))

    typed = users.withColumns({c: F.col(c).cast(money) for c in ("min_security", "max_security")})
    per_cell = (typed.join(totals, CELL)
                .join(bound(0, "min_security", "below"), [*CELL, "min_security"], "left")
                .join(bound(2, "max_security", "upto"), [*CELL, "max_security"], "left")
                .select("user_id", (F.col("unknown") + F.greatest(F.lit(0), F.coalesce(
                    "upto", "known") - F.coalesce("below", F.lit(0)))).alias("n")))
    counts = per_cell.groupBy("user_id").agg(F.sum("n").alias("candidates"))
    return profiles.select("user_id").join(counts, "user_id", "left").select(
        "user_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))


# ------------------------------------------------------------ the two arms

def _top(scored: DataFrame, score: str, limit: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc(score), "notice_id")
    return scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)


def _of_model(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors of two models live in different spaces and are never compared."""
    return vectors.filter(F.col("model") == model) if "model" in vectors.columns else vectors


def vector_arm(pairs: DataFrame, notice_vectors: DataFrame, profile_vectors: DataFrame,
               model: str, limit: int = ARM_LIMIT, unit: bool = True) -> DataFrame:
    """Top similarities per user among the candidates that have a vector."""
    vectors = notice_vectors.filter(F.col("model") == model).select(
        F.col("id").alias("notice_id"), F.col("embedding").alias("nv"))
    mine = _of_model(profile_vectors, model).select("user_id", F.col("embedding").alias("pv"))
    scored = (pairs.select(*PAIR).join(mine, "user_id").join(vectors, "notice_id")
              .select(*PAIR, F.round(cosine_similarity(F.col("nv"), F.col("pv"), unit), 6)
                      .alias("similarity")))
    return _top(scored, "similarity", limit).select(
        *PAIR, "similarity", (F.col("_rn") - 1).alias("vector_position"))


def profile_keywords(texts: DataFrame, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """Significant words per (user_id, text), commonest first, then alphabetical."""
    counts = (texts.select("user_id", F.explode(tokens(F.col("text"))).alias("word"))
              .filter(is_keyword(F.col("word"))).groupBy("user_id", "word")
              .agg(F.count("*").alias("n")))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "word")
    return (counts.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= limit))


def word_counts(notices: DataFrame, keywords: DataFrame) -> DataFrame:
    """(notice_id, counts): how often each word that is anyone's keyword occurs.

    Counting shrinks every text before the shuffle, and the join with the words is salted
    by notice, so a word found everywhere is spread over ``WORD_SALTS`` tasks; the words of a
    notice end up beside it in a small map."""
    salt = F.pmod(F.xxhash64("notice_id"), F.lit(WORD_SALTS)).cast("int")
    vocabulary = keywords.select("word").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))))
    return (notices.select(F.col("id").alias("notice_id"), F.explode(tokens(document())).alias("word"))
            .groupBy("notice_id", "word").agg(F.count("*").alias("n")).withColumn("salt", salt)
            .join(vocabulary, ["word", "salt"], "left_semi")
            .groupBy("notice_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n")))
                                      .alias("counts")))


def keyword_lists(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("user_id").agg(F.collect_set("word").alias("wanted"))


def keyword_hits() -> Column:
    """Occurrences of all of the user's keywords in the notice."""
    return F.coalesce(F.aggregate("wanted", F.lit(0).cast("long"), lambda n, word: n + F.coalesce(
        F.try_element_at("counts", word).cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"))


def keyword_arm(pairs: DataFrame, counts: DataFrame, keywords: DataFrame,
                limit: int = ARM_LIMIT) -> DataFrame:
    """Top keyword scores per user; ``counts`` comes from :func:`word_counts`."""
    scored = (pairs.select(*PAIR).join(keyword_lists(keywords), "user_id")
              .join(counts, "notice_id").select(*PAIR, keyword_hits().alias("hits"))
              .filter("hits > 0"))
    return _top(scored, "hits", limit).select(
        *PAIR, "hits", (F.col("_rn") - 1).alias("keyword_position"))


# ------------------------------------------------------------------ fusion

def reciprocal_rank(position: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K + 1) + position), F.lit(0.0))


def _fused(hits: DataFrame, limit: int, floor: float | None) -> DataFrame:
    """Scores, floor and reasons of pairs that carry their position in each arm."""
    best = F.max(F.when(F.col("vector_position").isNotNull(), F.col("similarity"))).over(
        Window.partitionBy("user_id"))
    relative = F.greatest(F.lit(ABSOLUTE_FLOOR), F.coalesce(
        best * RELATIVE_FLOOR, F.lit(ABSOLUTE_FLOOR)))
    df = hits.withColumn("floor", relative if floor is None else F.lit(floor))
    in_vector, in_words = F.col("vector_position").isNotNull(), F.col("keyword_position").isNotNull()
    similarity = F.when(in_vector, F.col("similarity"))
    kept = df.filter(in_words | (in_vector & (F.col("similarity") >= F.col("floor")))).select(
        *PAIR, (reciprocal_rank(F.col("vector_position"))
                + reciprocal_rank(F.col("keyword_position"))).alias("score"),
        similarity.alias("layer2_score"), F.when(in_words, F.col("hits")).alias("hits"),
        "vector_position", "keyword_position",
        F.struct(
            F.when(in_vector & in_words, "both").when(in_vector, "semantic")
            .otherwise("keyword").alias("matched_by"),
            F.round(similarity, 4).alias("similarity"),
            F.round("floor", 4).alias("floor")).alias("reasons"))
    return _top(kept, "score", limit).withColumnRenamed("_rn", "position")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int = MATCH_LIMIT,
         floor: float | None = None) -> DataFrame:
    """Fuse two ranked lists. A purely semantic hit must reach the floor, a
    fraction of the user's own best similarity; a keyword hit passes on its own."""
    return _fused(vector_hits.join(keyword_hits, PAIR, "full_outer"), limit, floor)


def match_all(notices: DataFrame, profiles: DataFrame, notice_vectors: DataFrame,
              profile_vectors: DataFrame, as_of: str, model: str, seen: list[DataFrame] = (),
              limit: int = MATCH_LIMIT, unit: bool = True, arm_limit: int = ARM_LIMIT, **options) -> DataFrame:
    """Matches of all profiles with a usable text, best first per user.

    Gives what :func:`fuse` gives for :func:`vector_arm` and :func:`keyword_arm`,
    but scores both arms in one pass over the candidates: they meet the user's
    vector and keywords in one join and the notice's vector and words in another,
    and both rankings, the floor and the final cut share the user's partition. A
    user has at most 500 candidates, so no group grows with the corpus."""
    texts = profile_texts(profiles).filter("text <> ''")
    usable = profiles.join(texts.select("user_id"), "user_id", "left_semi")
    pairs = candidates(notices, usable, as_of, seen, **options).select(*PAIR)
    vectors = notice_vectors.filter(F.col("model") == model).select(
        F.col("id").alias("notice_id"), F.col("embedding").alias("nv"))
    keywords = profile_keywords(texts)
    eligible = notices.filter(matchable(timestamp(as_of)))
    theirs = (eligible.select(F.col("id").alias("notice_id"))
              .join(word_counts(eligible, keywords), "notice_id", "left")
              .join(vectors, "notice_id", "left"))
    mine = texts.select("user_id").join(keyword_lists(keywords), "user_id", "left").join(
        _of_model(profile_vectors, model).select("user_id", F.col("embedding").alias("pv")), "user_id", "left")
    # The user's side travels to the pair, not the notice's: a dozen keywords and
    # a vector are shuffled per pair, what a notice says only once.
    scored = (pairs.join(mine, "user_id").join(theirs, "notice_id")
              .select(*PAIR, F.round(cosine_similarity(F.col("nv"), F.col("pv"), unit), 6)
                      .alias("similarity"), keyword_hits().alias("hits"))
              .filter(F.col("similarity").isNotNull() | (F.col("hits") > 0)))

    def position(score: str, present: Column) -> Column:
        w = Window.partitionBy("user_id").orderBy(F.col(score).desc_nulls_last(), "notice_id")
        rank = F.row_number().over(w) - 1
        return F.when(present & (rank < arm_limit), rank)

    ranked = scored.withColumns({
        "vector_position": position("similarity", F.col("similarity").isNotNull()),
        "keyword_position": position("hits", F.col("hits") > 0)})
    return _fused(ranked.filter("vector_position IS NOT NULL OR keyword_position IS NOT NULL"),
                  limit, None)


def upsert_matches(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """A new score and its reasons replace the stored ones of the same pair."""
    columns = fresh.columns
    kept = current.select(*columns).join(fresh.select(*PAIR), PAIR, "left_anti")
    return kept.unionByName(fresh)


def match_report(profiles: DataFrame, pairs: DataFrame, matches: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates, ranked matches and rows of the match table per user; a blank profile
    is a skip."""
    text = profile_texts(profiles).withColumn("skipped_no_profile", F.col("text") == "")
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    return (text.select("user_id", "skipped_no_profile")
            .join(count(pairs, "candidates"), "user_id", "left")
            .join(count(matches, "ranked"), "user_id", "left")
            .join(count(stored, "stored"), "user_id", "left")
            .fillna(0, ["candidates", "ranked", "stored"]))
