"""Account analytics: mood, insults, toxicity, rhythm, vocabulary, network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.arrays import unnest
from gumshoe.functions.language import STOP_WORDS
from gumshoe.functions.text import capitalised_names, hashtags, letter_tokens, mentions, tokens
from gumshoe.operators.ranking import carry_forward, first_by_key, top_per_group
from gumshoe.operators.words import UNITS, exact_mean, shifted_words, with_valence
from gumshoe.session import pin

# Weekday names from Monday.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
POST_STOP_WORDS = sorted(set(STOP_WORDS["en"]) | set(STOP_WORDS["fr"]))


def post_kind() -> Column:
    """`reply` or `post`: by the stored flag, else by a replied-to account."""
    flag = F.coalesce(F.col("is_reply"), F.coalesce("reply_did", F.lit("")) != "")
    return F.when(flag, "reply").otherwise("post")


def mood_label(average: Column) -> Column:
    return F.when(average >= 0.2, "positive").when(average <= -0.2, "negative").otherwise("neutral")


def _both(df: DataFrame) -> DataFrame:
    """Rows once under their own kind and once under `all`: one aggregation serves both, with
    partial sums before the shuffle."""
    return df.withColumn("kind", F.explode(F.array(F.lit("all"), "kind")))


def response_time(posts: DataFrame) -> DataFrame:
    """Adds the seconds between a post and what it answers, null when either time is missing."""
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(
        F.col("reply_created_at").cast("timestamp")
    )
    return posts.withColumn("response_time", seconds / 1e6)


def account_summary(posts: DataFrame) -> DataFrame:
    """Per account: posts, label counts of generated-text checks (`ai_label`), spelling totals
    (`spell_errors`) and mean response time; the check results are supplied columns."""
    rows = response_time(posts)
    label, errors = F.col("ai_label"), F.col("spell_errors")
    return rows.groupBy("did").agg(
        F.count(F.lit(1)).alias("posts_analysed"),
        F.count(F.when(label.isNotNull() & (label != "Too short"), 1)).alias("ai_scored"),
        F.count(F.when(label == "Too short", 1)).alias("ai_too_short"),
        F.count(F.when(errors > 0, 1)).alias("posts_with_spell_errors"),
        F.coalesce(F.sum("spell_errors"), F.lit(0)).alias("spell_errors_total"),
        F.count("response_time").alias("posts_with_reply_timing"),
        F.avg("response_time").alias("average_seconds"),
    )


def compound(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(cid, compound): summed valence of the listed words, squashed to -1..1; 0 without any."""
    words = shifted_words(posts, "cid").where(F.col("word").isNotNull())
    sums = with_valence(words, lexicon.select("word", "polarity"), "inner").groupBy("cid").agg(F.sum("valence").alias("_s"))
    value = F.coalesce("_s", F.lit(0)) / F.lit(float(UNITS))
    return posts.select("cid").join(sums, "cid", "left").select("cid", (value / F.sqrt(value * value + 15)).alias("compound"))


def account_mood(posts: DataFrame, moods: DataFrame) -> DataFrame:
    """(did, kind, count, average_compound, label) per kind and for `all`; `moods` is
    (cid, compound), supplied or from `compound`."""
    rows = posts.where(F.coalesce("text", F.lit("")) != "").select("did", "cid", post_kind().alias("kind"))
    joined = _both(rows.join(moods, "cid"))
    out = joined.groupBy("did", "kind").agg(
        F.count(F.lit(1)).alias("count"), exact_mean("compound").alias("average_compound")
    )
    return out.withColumn("label", mood_label(F.col("average_compound")))


def insult_hits(posts: DataFrame, swear: DataFrame) -> DataFrame:
    """(did, cid, kind, word): listed words per post, each once. Tokens are made distinct in the
    row, so the join sees a word once per post."""
    split = posts.select("did", "cid", post_kind().alias("kind"), F.array_distinct(letter_tokens(F.col("text"))).alias("_t"))
    words = unnest(split, "_t", "word", "did", "cid", "kind")
    return words.join(swear.select("word").distinct(), "word", "left_semi")


def account_insults(posts: DataFrame, swear: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(did, kind, total, with_insults, ratio): posts with a listed word or a supplied profanity
    flag (cid)."""
    rows = posts.where(F.coalesce("text", F.lit("")) != "").select("did", "cid", post_kind().alias("kind"))
    hit = insult_hits(posts, swear).select("cid")
    if flags is not None:
        hit = hit.union(flags.select("cid"))
    marked = rows.join(hit.distinct().withColumn("_hit", F.lit(1)), "cid", "left")
    out = _both(marked).groupBy("did", "kind").agg(
        F.count(F.lit(1)).alias("total"), F.count("_hit").alias("with_insults")
    )
    return out.withColumn("ratio", F.col("with_insults") / F.col("total"))


def insult_words(posts: DataFrame, swear: DataFrame) -> DataFrame:
    return insult_hits(posts, swear).groupBy("did", "word").agg(F.count(F.lit(1)).alias("n"))


def account_toxicity(posts: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(did, kind, scored, flagged, ratio_flagged) from supplied (cid, label, score) rows: a post
    is flagged when its top score reaches the threshold."""
    tops = scores.groupBy("cid").agg(F.max("score").alias("_top"))
    rows = posts.select("did", "cid", post_kind().alias("kind")).join(tops, "cid")
    out = _both(rows).groupBy("did", "kind").agg(
        F.count(F.lit(1)).alias("scored"), F.count(F.when(F.col("_top") >= threshold, 1)).alias("flagged")
    )
    return out.withColumn("ratio_flagged", F.col("flagged") / F.col("scored"))


def toxicity_flags(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cid, toxicity_flag): top label of the posts that reach the threshold."""
    best = scores.groupBy("cid").agg(F.max_by("label", F.struct("score", "label")).alias("toxicity_flag"), F.max("score").alias("_top"))
    return best.where(F.col("_top") >= threshold).select("cid", "toxicity_flag")


def toxicity_means(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """(did, label, average): summed score per label over all scored posts of the account."""
    rows = posts.select("did", "cid").join(scores, "cid")
    scored = rows.select("did", "cid").distinct().groupBy("did").agg(F.count(F.lit(1)).alias("_n"))
    # As decimals, as in `account_ai`.
    sums = rows.groupBy("did", "label").agg(F.sum(F.col("score").cast("decimal(20,9)")).alias("_s"))
    return sums.join(scored, "did").select("did", "label", (F.col("_s") / F.col("_n")).alias("average"))


def account_ai(posts: DataFrame, results: DataFrame) -> DataFrame:
    """(did, label, n, average_score) of generated-text labels; the mean is per account."""
    rows = posts.select("did", "cid").join(results, "cid")
    # As decimals: a binary sum depends on the order of its parts, and so does its rounding.
    exact = F.sum(F.col("score").cast("decimal(20,9)")) / F.count("score")
    means = rows.groupBy("did").agg(exact.alias("average_score"))
    return rows.groupBy("did", "label").agg(F.count(F.lit(1)).alias("n")).join(means, "did")


def word_frequency(posts: DataFrame, top: int = 20, min_length: int = 3, swear: DataFrame | None = None) -> DataFrame:
    """(did, word, n): most frequent words of each account, stop words (and swear words) out."""
    split = posts.select("did", letter_tokens(F.col("text")).alias("_t"))
    kept = F.filter("_t", lambda w: (F.length(w) >= min_length) & ~w.isin(*POST_STOP_WORDS))
    words = unnest(split, kept, "word", "did")
    counts = words.groupBy("did", "word").agg(F.count(F.lit(1)).alias("n"))
    if swear is not None:
        counts = counts.join(swear.select("word").distinct(), "word", "left_anti")
    return top_per_group(counts, ["did"], [F.desc("n"), F.asc("word")], top)


def account_top(posts: DataFrame, top: int = 20, swear: DataFrame | None = None) -> DataFrame:
    """(did, kind, key, n): top words, hashtags, mentions and entities in one table."""
    text = F.col("text")
    found = F.array(
        F.struct(F.lit("hashtag").alias("kind"), hashtags(text).alias("keys")),
        F.struct(F.lit("mention").alias("kind"), mentions(text).alias("keys")),
        F.struct(F.lit("entity").alias("kind"), capitalised_names(text).alias("keys")),
    )
    split = unnest(unnest(posts, found, "f", "did"), "f.keys", "key", "did", "f.kind")
    counts = split.groupBy("did", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_per_group(counts, ["did", "kind"], [F.desc("n"), F.asc("key")], top)
    words = word_frequency(posts, top, swear=swear)
    return ranked.unionByName(words.select("did", F.lit("word").alias("kind"), F.col("word").alias("key"), "n"))


def account_rhythm(posts: DataFrame) -> DataFrame:
    """(did, unit, slot, n): posts per hour 0-23 and per weekday, zero-filled.

    The 31 slots are columns of one aggregate, then unpivoted: no join with a calendar."""
    hour, day = F.hour("created_at"), F.weekday("created_at")
    rows = posts.where(F.col("created_at").isNotNull())
    counts = rows.groupBy("did").agg(
        *[F.count(F.when(hour == h, 1)).alias(f"h{h}") for h in range(24)],
        *[F.count(F.when(day == d, 1)).alias(f"d{d}") for d in range(7)],
    )
    slots = [F.struct(F.lit("hour").alias("unit"), F.lit(str(h)).alias("slot"), F.col(f"h{h}").alias("n")) for h in range(24)]
    slots += [F.struct(F.lit("weekday").alias("unit"), F.lit(WEEKDAYS[d]).alias("slot"), F.col(f"d{d}").alias("n")) for d in range(7)]
    return counts.select("did", F.explode(F.array(*slots)).alias("s")).select("did", "s.unit", "s.slot", "s.n")


def suspicious_clusters(followers: DataFrame, size: int = 5, ratio: float = 0.02) -> DataFrame:
    """(did, day, accounts_created, ratio_of_followers): days on which unusually many of an
    account's followers were created."""
    totals = followers.groupBy("did").agg(F.count(F.lit(1)).alias("_total"))
    days = followers.where(F.col("created_at").isNotNull()).groupBy("did", F.to_date("created_at").alias("day"))
    counts = days.agg(F.count(F.lit(1)).alias("accounts_created")).where(F.col("accounts_created") >= size)
    share = F.col("accounts_created") / F.col("_total")
    return counts.join(totals, "did").where(share >= ratio).select(
        "did", "day", "accounts_created", share.alias("ratio_of_followers")
    ).orderBy("did", F.desc("accounts_created"), "day")


def common_network(followers: DataFrame, follows: DataFrame, did: str) -> DataFrame:
    """(other, common_followers_count, common_follows_count): accounts sharing followers or
    follows with one account, most shared first. Each edge meets the start's edges at most
    once, so the join never multiplies rows."""

    def shared(edges: DataFrame, column: str, name: str) -> DataFrame:
        own = edges.where(F.col("did") == did).select(column).distinct()
        others = edges.where(F.col("did") != did).select(F.col("did").alias("other"), column).distinct()
        return others.join(own, column, "left_semi").groupBy("other").agg(F.count(F.lit(1)).alias(name))

    both = shared(followers, "follower", "common_followers_count").join(
        shared(follows, "followed", "common_follows_count"), "other", "full"
    ).fillna(0, ["common_followers_count", "common_follows_count"])
    return both.orderBy(F.desc(F.col("common_followers_count") + F.col("common_follows_count")), "other")


def common_accounts(edges: DataFrame, did: str, column: str) -> DataFrame:
    """(other, account): the shared accounts behind `common_network`, as rows."""
    own = edges.where(F.col("did") == did).select(column).distinct()
    others = edges.where(F.col("did") != did).select(F.col("did").alias("other"), column).distinct()
    return others.join(own, column, "left_semi").select("other", F.col(column).alias("account"))


def ratio_history(changes: DataFrame, current: DataFrame, now: str | Column) -> DataFrame:
    """(did, at, followers, follows, ratio): the step-wise history of both counts.

    `changes` rows (did, at, followers_count?, follows_count?) hold the value before a change;
    `current` closes both series at `now`. A point needs both values; the ratio is null when
    nobody is followed.
    """
    at = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    columns = ["did", "at", "followers_count", "follows_count"]
    series = changes.select(*columns).unionByName(current.withColumn("at", at).select(*columns))
    points = series.where(F.col("followers_count").isNotNull() | F.col("follows_count").isNotNull())
    points = points.groupBy("did", "at").agg(
        F.max("followers_count").alias("followers_count"), F.max("follows_count").alias("follows_count")
    )
    filled = carry_forward(points, ["did"], ["at"], ["followers_count", "follows_count"], F.date_trunc("day", "at"))
    known = filled.where(F.col("followers_count").isNotNull() & F.col("follows_count").isNotNull())
    ratio = F.when(F.col("follows_count") != 0, F.col("followers_count") / F.col("follows_count"))
    return known.select("did", "at", F.col("followers_count").alias("followers"), F.col("follows_count").alias("follows"), ratio.alias("ratio"))


def under_roots(links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, root, steps) for every node whose chain of parents ends at a root, (node) for the others
    that were still on their way when a round found none: members of circles and what hangs from them).

    `links` is (node, parent), one parent for each node; `roots` is (node). Each node jumps twice as far
    every round, so the rounds grow with the logarithm of the depth, and every round is one equi
    join, written so that the plan stays flat. A chain that leaves the table drops out.
    """
    done = pin(roots.select("node", F.col("node").alias("up"), F.lit(0).alias("steps")))
    left = pin(links.select("node", F.col("parent").alias("up"), F.lit(1).alias("steps")))
    while True:
        both = left.withColumn("_end", F.lit(False)).unionByName(done.withColumn("_end", F.lit(True)))
        jump = both.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), "_end")
        moved = pin(
            left.join(jump, "up").select("node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), "_end")
        )
        found = moved.where("_end").drop("_end")
        left = moved.where("not _end").drop("_end")
        # Were there a chain still open, the nodes up to twice the depth reached would have ended now.
        if found.isEmpty():
            return done.select("node", F.col("up").alias("root"), "steps"), left.select("node")
        done = done.unionByName(found)


def thread_rows(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((root, did, step, cid, text): the chain of same-author replies under each root post, in rows,
    (cid) of the posts that answer each other in a circle).

    `replies` is (cid, parent, did, created_at, text). The first same-author reply to a post (by
    time, then id) continues its chain, so every chained post has one predecessor.
    """
    posts = pin(replies.select("cid", "parent", "did", "created_at", "text"))
    answers = posts.where(F.col("parent").isNotNull()).select("parent", "did", "created_at", "cid")
    chained = first_by_key(answers, ["parent", "did"], ["created_at", "cid"])
    authors = posts.select(F.col("cid").alias("parent"), "did")
    links = chained.join(authors, ["parent", "did"], "left_semi").select(F.col("cid").alias("node"), "parent")
    placed, circles = under_roots(links, posts.where(F.col("parent").isNull()).select(F.col("cid").alias("node")))
    rows = placed.select(F.col("node").alias("cid"), "root", F.col("steps").alias("step")).join(posts.select("cid", "did", "text"), "cid")
    return rows.select("root", "did", "step", "cid", "text"), circles.select(F.col("node").alias("cid"))


#: Posts of a thread whose texts share a cell.
PART_POSTS = 256


def thread_text(replies: DataFrame, posts: int = PART_POSTS) -> DataFrame:
    """(root, did, part, text, replies): the same chains with their texts joined by lines, so many posts to a part,
    and the step of a part's last one. However long a thread is, no task gathers more than a part of it."""
    rows, _ = thread_rows(replies)
    parts = rows.withColumn("part", F.call_function("div", F.col("step"), F.lit(posts)).cast("int"))
    return parts.groupBy("root", "did", "part").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("step", "text")))["text"], "\n").alias("text"),
        F.max("step").alias("replies"),
    )


def story_tree(stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((root, name, parent, pager): every story under its root, the page number being its depth,
    (name) of the stories that run in a circle or hang from one)."""
    links = stories.where(F.col("parent").isNotNull()).select(F.col("name").alias("node"), "parent")
    roots = stories.where(F.col("parent").isNull()).select(F.col("name").alias("node"))
    placed, circles = under_roots(links, roots)
    named = placed.select("root", F.col("node").alias("name"), (F.col("steps") + 1).alias("pager"))
    return named.join(stories.select("name", "parent"), "name").select("root", "name", "parent", "pager"), circles.select(F.col("node").alias("name"))
