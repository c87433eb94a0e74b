"""Chat formatting by event sourcing, DataFrame functions only: a log of events is folded into final messages, which are rendered.

A log row is an event (conv_id, seq, message, role, kind, text) on a message; ``message`` is its number in the conversation,
``seq`` the order in which things happened.  Kinds:

* ``start``: the message begins, with this role and text;
* ``delta``: the text is appended (a streamed piece);
* ``edit``: the text takes the place of what was there; messages of higher number that began earlier are withdrawn, as they
  answered what is no longer there;
* ``regenerate``: as ``edit``, the text being the beginning of the new reply.

So the final text of a message is what its last ``start``, ``edit`` or ``regenerate`` and the deltas behind it hold, and a message
stands if that event is later than all edits and regenerations of messages of lower number.  Deltas without a
beginning, or behind a withdrawn one, are dropped.  The role is the last one that any event of the message gives.

The fold goes by message first (events of one message are sorted and joined in one pass), and a conversation is gathered only from
its final messages.  A message and a rendered conversation are one row each, so they are bounded by what a row can hold, as any
formatted conversation is; copies of a conversation are rows of their own and don't meet.

Template.  A turn is ``<s>[INST]`` role ``[/INST]`` text ``</s>``.  In roles and texts, a control string (``CONTROL``) gets a backslash
before its last part (``</s>`` becomes ``</\\s>``), one that has backslashes there gets one more, so that escaping is reversible and
no control string stands inside a text.  Each turn's place, and the place of the text that carries loss (turns of the
roles in ``loss_roles``), are code point spans of the formatted text.

Defined results: null text and role are empty strings; a null conv_id is a conversation of its own; null seq and message go first;
events equal in seq go by kind (beginnings before deltas), role and text, each repeated event counts.  An empty log gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: <s>, </s>, [INST] and [/INST], with any number of backslashes before the last part
CONTROL = r"(</?|\[/?)(\\*)(s>|INST\])"
ESCAPED = r"(</?|\[/?)\\(\\*)(s>|INST\])"
PIECE = 512  # code points of a streamed delta in ``log_of_turns``


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


# ------------------------------------------------------------------------------------------ the log

def log_of_turns(turns: DataFrame) -> DataFrame:
    """A log that tells how the turns of a table (conv_id, turn, role, text) came to be.

    Turns are numbered by turn (nulls first), then role and text, and each is streamed in deltas of ``PIECE`` code points.
    A quarter of them, by the crc32 of the text, is first logged cut short: those of role assistant are then regenerated, the others
    edited.  Folding the log gives the table's turns again."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("message", F.row_number().over(order).cast("long"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), 0)

    def event(kind: str, role, text) -> Column:
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none = F.lit(None).cast("string")
    deltas = F.transform(F.col("pieces"), lambda p: event("delta", none, p))
    first = F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))
    again = F.when(F.col("role") == "assistant", event("regenerate", none, F.lit(""))).otherwise(event("edit", none, F.lit("")))
    events = (F.when(F.crc32(F.col("text").cast("binary")) % 4 == 0,
                     F.concat(F.array(event("start", F.col("role"), F.lit("")), event("delta", none, first), again), deltas))
              .otherwise(F.concat(F.array(event("start", F.col("role"), F.lit(""))), deltas)))
    e = t.withColumn("pieces", pieces).select("conv_id", "message", F.posexplode(events).alias("at", "event"))
    return e.select("conv_id", (F.col("message") * F.lit(1 << 32) + F.col("at")).alias("seq"), "message", "event.role", "event.kind", "event.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log, one row each."""
    begins = F.col("kind").isin("start", "edit", "regenerate")
    e = log.where(begins | (F.col("kind") == "delta")).select(
        "conv_id", "message", F.struct(F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), F.when(begins, 0).otherwise(1).alias("rank"), "kind", "role",
                                       F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    m = e.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list("e")).alias("es"),
        F.max(F.when(F.col("e.rank") == 0, F.col("e.seq"))).alias("began"),
        F.max(F.when(F.col("e.kind").isin("edit", "regenerate"), F.col("e.seq"))).alias("rewrote"))
    before = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("cut", F.max("rewrote").over(before)).where("began IS NOT NULL AND (cut IS NULL OR began > cut)")
    last = F.array_max(F.transform("es", lambda x, i: F.when(x["rank"] == 0, i)))
    roles = F.filter(F.transform("es", lambda x: x["role"]), lambda r: r.isNotNull())
    return m.select("conv_id", "message", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
                    F.array_join(F.transform(F.slice("es", last + 1, F.size("es")), lambda x: x["text"]), "").alias("text"))


# ------------------------------------------------------------------------------------------ rendering

def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (array of start, length, loss_start, loss_length; code points from 0,
    loss_length 0 where a turn carries no loss)."""
    m = messages.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END))).withColumn("body", escape(F.col("text")))
    m = m.select("conv_id", "message", F.length("head").alias("h"), F.when(F.col("role").isin(*loss_roles), F.length("body")).otherwise(0).alias("loss"),
                 F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    m = m.withColumn("length", F.length("piece"))
    before = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum(F.col("length").cast("long")).over(before), F.lit(0)))
    turn = F.struct("start", F.col("length").cast("long").alias("length"), (F.col("start") + F.col("h")).alias("loss_start"),
                    F.col("loss").cast("long").alias("loss_length"), "piece")
    all_turns = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    return all_turns.select("conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
                            F.transform("ts", lambda t: t.dropFields("piece")).alias("turns"))


def format_chats(log: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``render`` of the messages that the log folds into."""
    return render(reconstruct(log), loss_roles)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, messages (array of role, text) and loss (texts under the mask) as the formatted text and its spans say."""
    cut = F.split("formatted", CLOSE)  # behind the last end of a turn stands an empty rest
    pieces = F.slice(cut, 1, F.size(cut) - 1)

    def message(piece: Column) -> Column:
        two = F.split(F.substring(piece, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2)
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    def under_mask(piece: Column, turn: Column) -> Column:
        at = (turn["loss_start"] - turn["start"] + 1).cast("int")
        return unescape(piece.substr(at, turn["loss_length"].cast("int")))

    return formatted.withColumn("pieces", pieces).select(
        "conv_id", "formatted", F.transform("pieces", message).alias("messages"), F.zip_with("pieces", "turns", under_mask).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the output."""
    r = read_back(formatted).withColumn("loss", F.array_join("loss", ""))
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
