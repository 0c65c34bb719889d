r"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns lie end to end on a line of tokens, by prefix sums over a conversation. The first turn, if it is a system turn, is
repeated in each window, so the line after it is cut every BUDGET less its tokens (LEAST_NEW at least):
the turns that lie wholly in one cell are a window's new turns; a turn that crosses a cut is a window
of its own. So windows are turn-aligned and hold every turn once as new. A window also has, not for the
loss, that system turn, and up to HISTORY turns before its own, of HISTORY_TOKENS in all and of what the
budget still has room for. So a whole window exceeds the budget only where a single turn with
the system turn does, or the system turn leaves less than LEAST_NEW. The loss mask covers new assistant texts.

A turn is its marks around its escaped text:
user [INST]...[/INST], assistant <s>...</s>, system <<SYS>>...<</SYS>>, any other role
[ROLE]role[:]...[/ROLE]. Within texts ~ becomes ~t and each mark ~ and a letter, so a
formatted text has no mark but the template's, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS, LEAST_NEW = 1024, 4, 256, 256
CHARS_A_TOKEN, TURN_TOKENS = 4, 4

# The template's marks and the escapes of their strings within texts.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "[ROLE]", "[:]", "[/ROLE]"
ESCAPES = (
    ("~", "~t"), ("<<SYS>>", "~a"), ("<</SYS>>", "~b"), ("[INST]", "~c"), ("[/INST]", "~d"), ("<s>", "~e"), ("</s>", "~f"), ("[ROLE]", "~g"), ("[/ROLE]", "~h"), ("[:]", "~i"),
)


def escape(c: F.Column) -> F.Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: F.Column) -> F.Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _by_role(known: dict[str, str], other: F.Column) -> F.Column:
    out = None
    for role, mark in known.items():
        out = F.when(F.col("role") == role, F.lit(mark)) if out is None else out.when(F.col("role") == role, F.lit(mark))
    return out.otherwise(other)


def windows(conversations: DataFrame) -> DataFrame:
    """conversations: (conv_id, turn, role, text, ...) -> (conv_id, window, formatted, n_context, tokens, loss array<struct<start, stop>>).

    One row per window. n_context: turns at the window's start that aren't new. tokens: of all its turns. loss: stretches
    of formatted, in code points from 0, end exclusive. A null text or role counts as empty; rows of a
    null conv_id are one conversation. Turns are in the order of turn, nulls first,
    then role and text; repeated rows are turns of their own. An empty table gives no rows.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    other = F.concat(F.lit(OTHER_OPEN), escape(F.col("role")), F.lit(OTHER_MID))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = (
        turns.withColumn("lead", _by_role(OPEN, other)).withColumn("body", escape(F.col("text"))).withColumn("tail", _by_role(CLOSE, F.lit(OTHER_CLOSE)))
        .withColumn("tokens", (F.length("body") + CHARS_A_TOKEN - 1 - F.pmod(F.length("body") + CHARS_A_TOKEN - 1, F.lit(CHARS_A_TOKEN))) / CHARS_A_TOKEN + TURN_TOKENS).withColumn("tokens", F.col("tokens").cast("long"))
        .withColumn("stop", F.sum("tokens").over(upto)).withColumn("place", F.row_number().over(line) - 1)
        .withColumn("begin", F.col("stop") - F.col("tokens"))
        .withColumn("system_tokens", F.coalesce(F.first(F.when(F.col("role") == "system", F.col("tokens"))).over(upto), F.lit(0)))
        .withColumn("room", F.expr(f"greatest({BUDGET} - system_tokens, {LEAST_NEW})"))
        .withColumn("cell", F.expr("2 * (greatest(begin - system_tokens, 0) div room) + IF(greatest(begin - system_tokens, 0) div room = (greatest(stop - system_tokens, 1) - 1) div room, 0, 1)"))
        .withColumn("first", F.coalesce(F.lag("cell").over(line) != F.col("cell"), F.lit(True))).withColumn("window", F.sum(F.col("first").cast("int")).over(upto).cast("int") - 1)
    )
    piece = F.struct("place", "role", "lead", "body", "tail", "begin", "tokens")
    # what a window repeats is read at its first turn, so no row holds more than HISTORY + 1 other turns
    turns = turns.withColumn("opening", F.first(F.when(F.col("role") == "system", piece)).over(upto)).withColumn("before", F.array(*[F.lag(piece, k).over(line) for k in range(HISTORY, 0, -1)]))
    once = F.when(F.col("first"), F.struct("opening", "before", "system_tokens"))
    marked = turns.select("conv_id", "window", piece.alias("piece"), once.alias("around"))
    limit = f"least({HISTORY_TOKENS}, {BUDGET} - around.system_tokens - new_tokens)"
    built = (
        marked.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("piece")).alias("new"), F.first("around", ignorenulls=True).alias("around"), F.sum("piece.tokens").alias("new_tokens"))
        .withColumn("history", F.expr(f"filter(around.before, t -> t IS NOT NULL AND new[0].begin - t.begin <= {limit})"))
        .withColumn("context", F.expr("concat(filter(array(around.opening), t -> t IS NOT NULL AND new[0].place > 0 AND NOT exists(history, h -> h.place = 0)), history)"))
        .withColumn("pieces", F.concat("context", "new")).withColumn("n_context", F.size("context").cast("long"))
        .withColumn("tokens", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.tokens)"))
        .withColumn("ends", F.expr("aggregate(pieces, array(0), (a, p) -> concat(a, array(element_at(a, -1) + length(p.lead) + length(p.body) + length(p.tail))))"))
        .withColumn("loss", F.expr("""transform(filter(sequence(0, size(pieces) - 1), i -> i >= n_context AND pieces[i].role = 'assistant'),
            i -> struct(ends[i] + length(pieces[i].lead) AS start, ends[i] + length(pieces[i].lead) + length(pieces[i].body) AS stop))"""))
        .withColumn("formatted", F.expr("array_join(transform(pieces, p -> concat(p.lead, p.body, p.tail)), '')"))
    )
    return built.select("conv_id", "window", "formatted", "n_context", "tokens", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """windows' rows -> (conv_id, window, turns array<struct<role, text>>, loss_texts array<string>): the new turns, from the formatted text alone."""
    pattern = r"(<<SYS>>|\\[INST\\]|<s>|\\[ROLE\\])([\\s\\S]*?)(<</SYS>>|\\[/INST\\]|</s>|\\[/ROLE\\])"
    found = formatted.select(
        "conv_id", "window", "n_context", "formatted", "loss", F.expr(f"regexp_extract_all(formatted, '{pattern}', 1)").alias("leads"), F.expr(f"regexp_extract_all(formatted, '{pattern}', 2)").alias("bodies")
    )

    def turn(i: F.Column) -> F.Column:
        lead, body = F.get("leads", i), F.get("bodies", i)
        role = F.when(lead == OTHER_OPEN, unescape(F.substring_index(body, OTHER_MID, 1)))
        for name, mark in OPEN.items():
            role = role.when(lead == mark, F.lit(name))
        text = F.when(lead == OTHER_OPEN, F.substring(body, F.instr(body, OTHER_MID) + F.lit(len(OTHER_MID)), F.length(body))).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    new = F.slice(F.sequence(F.lit(0), F.size("leads") - 1), F.col("n_context").cast("int") + 1, F.size("leads"))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return found.select("conv_id", "window", F.transform(new, turn).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows), read back from the windows."""
    back = read_back(windows(conversations))
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss_texts"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    turns, loss = F.flatten(F.col("w.turns")), F.array_join(F.flatten(F.col("w.loss_texts")), "")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows"
    )
