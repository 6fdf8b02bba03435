"""Chat formatting: a role automaton and a declarative template, read back without loss. [native: DataFrame functions only]"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Roles map to a header word and whether their text is trained on. `[TURN x]` and `[/TURN]` frame each turn, `<s>`/`</s>` the conversation.

    allowed: for each state of the automaton, the states that a turn's role may lead to; a role's state is its own name, `*` is any other role.
    """

    begin: str = "<s>"
    end: str = "</s>"
    open_turn: str = "[INST role="
    open_end: str = "]"
    close_turn: str = "[/INST]"
    loss_roles: tuple[str, ...] = ("assistant",)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


def escape(c: Column) -> Column:
    """Reversible; no control string survives, since each one holds `<s>`, `</s>` or `[`+word that starts with one of the three replaced characters."""
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    c = F.regexp_replace(c, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(c, r"\[(?=/?INST)", r"\\s")


def unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\s"), F.lit("["))
    c = F.replace(c, F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    """Roles stand in the header, up to its `]`: that one is escaped too."""
    return F.replace(escape(c), F.lit("]"), F.lit("\\e"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\e"), F.lit("]")))


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted: one row a conversation.

    Rows are (conv_id, turn, role, text); other columns are ignored. Turns go by turn, then role, then text (ties and repeated rows stay, in
    that order; null turns first). A null role or text is empty. A null conv_id is one conversation. `valid` is the automaton's verdict on the
    order of roles; invalid conversations are formatted all the same, so that no row is lost. An empty table gives no rows. A conversation is
    one output row, so its turns meet in one task; nothing else does.
    """
    t = template
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63)).cast("long")).alias("turn"), "role", "text"))).alias("turns"))

    def step(acc, x):
        ok = F.lit(False)
        for state, targets in t.allowed.items():
            ok = ok | ((acc["state"] == state) & x["role"].isin(*targets))
        return F.struct(x["role"].alias("state"), (acc["ok"] & ok).alias("ok"))

    start = F.struct(F.lit("").alias("state"), F.lit(True).alias("ok"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    body = F.flatten(F.transform("turns", lambda x: F.array(
        seg(F.concat(F.lit(t.open_turn), escape_role(x["role"]), F.lit(t.open_end)), no),
        seg(escape(x["text"]), x["role"].isin(*t.loss_roles)),
        seg(F.lit(t.close_turn), no),
    )))
    framed = F.concat(F.array(seg(F.lit(t.begin), no)), body, F.array(seg(F.lit(t.end), no)))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", start, step)["ok"].alias("valid"), framed.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def with_loss_mask(formatted: DataFrame) -> DataFrame:
    """Adds loss_mask array<struct<length, loss>>: runs of code points that cover `formatted` from its start to its end, a run a segment."""
    return formatted.withColumn("loss_mask", F.transform("segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("length"), s["loss"].alias("loss"))))


def read_back(output: DataFrame, template: Template = Template()) -> DataFrame:
    """From (conv_id, formatted, loss_mask) alone: turns array<struct<role, text>> and loss_texts array<string>, unescaped.

    `formatted` is cut once, and its turns' texts are held against the mask's runs in order (a frame, then header, text and close of each turn, then a frame);
    one that is not as long as its run is an error. So a conversation takes time in proportion to its length.
    """
    t = template
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c not in " " else c for c in s)
    turn = f"(?s){quote(t.open_turn)}([^{quote(t.open_end)}]*){quote(t.open_end)}(.*?){quote(t.close_turn)}"
    roles, texts = F.regexp_extract_all("formatted", F.lit(turn), 1), F.regexp_extract_all("formatted", F.lit(turn), 2)
    runs = F.filter("loss_mask", lambda _, i: i % 3 == 2)
    under = F.transform(F.arrays_zip(texts.alias("text"), runs.alias("run")), lambda z: F.struct(
        F.when(F.length(z["text"]) == z["run"]["length"], z["text"]).otherwise(F.raise_error(F.lit("a turn's text and its run of the mask differ in length"))).alias("text"), z["run"]["loss"].alias("loss")
    ))
    return output.withColumn("turns", F.arrays_zip(F.transform(roles, unescape_role).alias("role"), F.transform(texts, unescape).alias("text"))).withColumn(
        "loss_texts", F.transform(F.filter(under, lambda z: z["loss"]), lambda z: unescape(z["text"]))
    )


def chat_digest(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """The query's columns, all taken from the formatted strings and loss masks."""
    out = with_loss_mask(format_conversations(rows, template)).select("conv_id", "valid", "formatted", "loss_mask")
    back = read_back(out, template)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
