"""Chat formatting by quotation linking, with DataFrame functions alone.

Lines that begin with ``>`` are quotations; the number of marks is their level. Quoted passages are normalised and
hashed and joined, within a conversation, to the earliest message that says the same in its own words. The closest
quoted level decides which message a message replies to. Reply threads are ordered by their root and then by turn:
a reply always follows what it replies to. Every step of linking is an equi-join or an aggregate with map-side
combination on (conv_id, hash) or (conv_id, turn); ``conversations`` then builds rows of a bounded number of messages, so
no long conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, written

MARKS = r"^([ \t]*>)+"
#: How mail programs announce a quotation; such a line ends with a colon.
WROTE = ["wrote", "writes", "said", "schrieb", "a écrit", "escribió", "ha scritto", "escreveu", "написал", "написала", "كتب", "写道"]
ATTRIBUTION = r"(?i)(^|[\s>])(" + "|".join(WROTE) + r")[^:]{0,80}:\s*$"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def _key(text: Column) -> Column:
    return F.sha2(_squeezed(text), 256)


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: _squeezed(x) != "")


def sentences(text: Column) -> Column:
    """Sentences of a text whose white space is squeezed, so that line breaks make no difference."""
    return _filled(F.split(_squeezed(text), r"(?<=[.!?…]) |(?<=[。！？])"))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines (level, body; without lines that announce a deeper quotation after them), blocks (level, text: runs of lines of one level) and own (the text without quotes)."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", "")).alias("level"),
            F.regexp_replace(F.regexp_replace(x, MARKS, ""), r"^[ \t]", "").alias("body"),
        ),
    )
    announces = lambda x, i: x.body.rlike(ATTRIBUTION) & (F.get("lines", i + 1).level > x.level)
    d = messages.withColumn("lines", lines).withColumn("lines", F.filter("lines", lambda x, i: ~F.coalesce(announces(x, i), F.lit(False))))
    last = F.size("lines")
    starts = F.filter(F.sequence(F.lit(1), last), lambda i: (i == 1) | (F.element_at("lines", i).level != F.element_at("lines", F.greatest(i - 1, F.lit(1))).level))
    d = d.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(last + 1))
    blocks = F.transform(
        F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")),
        lambda r: F.struct(F.element_at("lines", r.a).level.alias("level"), F.array_join(F.transform(F.slice("lines", r.a, r.b - r.a), lambda x: x.body), "\n").alias("text")),
    )
    own = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.body), "\n")
    return d.withColumn("blocks", blocks).withColumn("own", F.regexp_replace(own, r"^[\s]+|[\s]+$", "")).drop("starts")


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn (null: replies to none), root_turn, depth, n_quotes
    (quoted passages), n_linked (of them, found in an earlier message), formatted (role mark and own text), unlinked
    (level and text of quoted passages that no earlier message says, so that no text is lost).

    Ordering by conv_id, root_turn, turn gives every reply after what it replies to. Where several earlier messages
    say what is quoted, the earliest counts; where several passages are linked, the lowest level, then the latest
    message. A passage is looked for as a whole, then by its lines, then by its sentences (also where they are wrapped
    anew), lines and sentences without a space last; blank passages link nothing. A line such as "On Monday A wrote:"
    right before a deeper quotation is no own text.
    A null or empty text has no quotes and an empty formatted body; a null role is printed as "unknown". Rows with a
    null conv_id or turn link to none. Repeated rows (same conv_id and turn) are kept and treated alike. An empty
    table gives no rows; other columns are ignored.
    """
    m = parsed(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    quoted = F.filter("blocks", lambda b: (b.level > 0) & (_squeezed(b.text) != ""))
    base = written(
        m.select("conv_id", "turn", "role", "own", F.size(F.filter("blocks", lambda b: b.level > 0)).alias("n_quotes"), quoted.alias("quoted"), F.transform(F.filter("blocks", lambda b: b.level == 0), lambda b: b.text).alias("said")),
        "messages",
    )
    # Keys of a quoted passage: the whole, its lines, its sentences; those of a higher rank count only where none of a
    # lower one is found (rank 3: lines and sentences without a space).
    q = base.where(F.size("quoted") > 0).select("conv_id", "turn", F.posexplode("quoted").alias("n", "q"))
    lines = lambda text: _filled(F.split(text, "\n"))
    ranked_keys = lambda parts, rank: F.transform(parts, lambda x: F.struct(F.when(F.contains(_squeezed(x), F.lit(" ")), rank).otherwise(3).alias("rank"), _key(x).alias("key")))
    keys = F.array_union(F.array(F.struct(F.lit(0).alias("rank"), _key(F.col("q.text")).alias("key"))), F.array_union(ranked_keys(lines(F.col("q.text")), 1), ranked_keys(sentences(F.col("q.text")), 2)))
    q = q.select("conv_id", "turn", "n", F.col("q.level").alias("level"), _key(F.col("q.text")).alias("passage"), F.explode(keys).alias("k"))
    wanted = written(q.select("conv_id", "turn", "n", "level", "passage", "k.rank", "k.key"), "quotes")
    links = None
    if not wanted.isEmpty():
        # Only conversations with quotes are indexed.
        some = base.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi").where("conv_id is not null and turn is not null")
        said = F.array_distinct(F.concat(F.array("own"), F.col("said"), F.flatten(F.transform("said", lambda t: F.split(t, "\n"))), sentences(F.col("own")), F.flatten(F.transform("said", sentences))))
        index = some.select("conv_id", F.col("turn").alias("at"), F.explode(F.array_distinct(F.transform(said, _key))).alias("key")).groupBy("conv_id", "key").agg(F.min("at").alias("at"))
        hit = wanted.join(index, ["conv_id", "key"]).where(F.col("at") < F.col("turn"))
        best = hit.groupBy("conv_id", "turn", "n", "level", "passage").agg(F.max(F.struct(-F.col("rank"), "at")).alias("b"))
        # The lowest level wins, then the latest message.
        links = written(
            best.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("b.at").alias("at"))).alias("w"), F.size(F.collect_set("n")).cast("long").alias("n_linked"), F.collect_set("passage").alias("linked")).select("conv_id", "turn", F.col("w.at").alias("parent_turn"), "n_linked", "linked"),
            "links",
        )
    out = base.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), "n_quotes", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "own").alias("formatted"), "quoted")
    names = ["conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked", "formatted"]
    n_quotes = F.col("n_quotes").cast("long").alias("n_quotes")
    if links is None:
        removed(wanted)
        return out.withColumns({"parent_turn": F.lit(None).cast("long"), "root_turn": F.col("turn"), "depth": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")}).select(*names[:6], n_quotes, *names[7:], F.col("quoted").alias("unlinked"))
    return out.join(roots(links), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), n_quotes, F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "formatted",
        F.filter("quoted", lambda x: ~F.coalesce(F.array_contains("linked", _key(x.text)), F.lit(False))).alias("unlinked"),
    )


def roots(links: DataFrame) -> DataFrame:
    """Adds root_turn and depth by pointer doubling over the replies: as many rounds as the logarithm of the depth."""
    now = links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv_id", "up"], "left")
        step = written(joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "replies")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return links.join(now.withColumnRenamed("up", "root_turn"), ["conv_id", "turn"])


def ranked(messages: DataFrame, block: int = 256) -> DataFrame:
    """Adds rank: the place (from 0) of a message in its conversation in reply order (root_turn, turn, then its text).

    No task sorts a conversation. Messages are counted by thread and stretch of ``block`` turns; what stands before a
    stretch is a sum of counts: of earlier blocks of threads, of earlier threads of the block, of earlier stretches of the
    thread. Only the messages of one stretch are ordered together."""
    key = ["conv_id", "root_turn", "_stretch"]
    m = messages.withColumn("_stretch", F.floor(F.col("turn") / block))
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = lambda d, *by: d.groupBy(*by).agg(F.sum("_n").alias("_n"))
    stretches = m.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    threads = counted(stretches, "conv_id", "root_turn").withColumn("_block", F.floor(F.col("root_turn") / block))
    blocks = counted(threads, "conv_id", "_block").select("conv_id", "_block", before(["conv_id"], "_block").alias("_a"))
    threads = threads.select("conv_id", "_block", "root_turn", before(["conv_id", "_block"], "root_turn").alias("_b")).join(blocks, ["conv_id", "_block"])
    stretches = stretches.select(*key, before(["conv_id", "root_turn"], "_stretch").alias("_c")).join(threads, ["conv_id", "root_turn"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("turn", "formatted")) - 1
    placed = m.withColumn("_d", place).join(stretches.select(*key, (F.col("_a") + F.col("_b") + F.col("_c")).alias("_before")), key)
    return placed.withColumn("rank", F.col("_before") + F.col("_d")).drop("_stretch", "_d", "_before")


def conversations(messages: DataFrame, most: int = 256) -> DataFrame:
    """Conversations without quotes, from the rows of ``chat_format``: conv_id, root_turn, part, n_messages, n_linked,
    conversation (the formatted messages in reply order, a blank line between them), messages (turn, role, parent_turn,
    root_turn, depth, n_quotes, n_linked, unlinked of each, in that order).

    Reply order is by root_turn, then turn; without quotes that is the order of turns. A conversation is a row for every
    ``most`` of its messages in that order: part 0 holds the first, and parts one after the other make the whole;
    root_turn is that of a part's first message. Rows with a null conv_id or turn are a conversation each; repeated rows
    (same conv_id and turn) all stay, in the order of their text. An empty table gives no rows.
    """
    item = F.struct("root_turn", "turn", "formatted", "role", "parent_turn", "depth", "n_quotes", "n_linked", "unlinked")
    complete = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    whole = written(messages, "formatted")
    m = ranked(whole.where(complete)).withColumn("_part", F.floor(F.col("rank") / most))
    rows = m.groupBy("conv_id", "_part").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))), lambda x: x.x).alias("m"))
    single = whole.where(~complete).select("conv_id", F.lit(0).cast("long").alias("_part"), F.array(item).alias("m"))
    lean = lambda x: F.struct(x.turn.alias("turn"), x.role.alias("role"), x.parent_turn.alias("parent_turn"), x.root_turn.alias("root_turn"), x.depth.alias("depth"), x.n_quotes.alias("n_quotes"), x.n_linked.alias("n_linked"), x.unlinked.alias("unlinked"))
    return rows.unionByName(single).select(
        "conv_id", F.get("m", F.lit(0)).root_turn.alias("root_turn"), F.col("_part").alias("part"), F.size("m").cast("long").alias("n_messages"),
        F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x.n_linked).alias("n_linked"),
        F.array_join(F.transform("m", lambda x: x.formatted), "\n\n").alias("conversation"), F.transform("m", lean).alias("messages"),
    )
