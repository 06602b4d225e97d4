"""Prompts and event rows of an assistant; the model itself is a boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FLUSH = 12


def context_block(snippets: DataFrame, conversation: str = "conv_id", rank: str = "rank", text: str = "snippet") -> DataFrame:
    """One text a conversation: its snippets by rank, ruled off from each other."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: x[text])
    return snippets.groupBy(conversation).agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))


def messages(history: DataFrame, questions: DataFrame, system: str, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, messages): the system text, the turns in order, the question with its context."""
    past = F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    turns = history.groupBy(conversation).agg(past.alias("past"))
    met = questions.join(turns, conversation, "left")
    asked = F.concat(F.lit("SCHEME RECORDS:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQUESTION: "), F.col("question"))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return met.select(conversation, F.concat(one("system", F.lit(system)), F.coalesce("past", none), one("user", asked)).alias("messages"))


def coalesced(tokens, least: int = FLUSH) -> list[str]:
    """Deltas joined until they have the least length; the rest at the end."""
    out, held = [], ""
    for t in tokens:
        held += t
        if len(held) >= least:
            out.append(held)
            held = ""
    return out + [held] * bool(held)


def coalesce_deltas(deltas: Column | str, least: int = FLUSH) -> Column:
    """coalesced() as a column."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, t: Column) -> Column:
        held = F.concat(acc["held"], t)
        full = F.struct(F.concat(acc["out"], F.array(held)).alias("out"), F.lit("").alias("held"))
        return F.when(F.length(held) >= least, full).otherwise(F.struct(acc["out"].alias("out"), held.alias("held")))

    end = lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))
    return F.aggregate(F.col(deltas) if isinstance(deltas, str) else deltas, start, step, end)


def events(answers: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, seq, event): status, tokens, then citations, or an error in their place.

    `answers` (conversation, deltas, error, citations) are recorded; citations come from
    the rows retrieved, never from the text.
    """
    event = lambda kind, data: F.struct(F.lit(kind).alias("type"), data.alias("data"))
    tokens = F.transform(coalesce_deltas("deltas"), lambda t: event("token", t))
    last = F.when(F.col("error").isNotNull(), event("error", F.col("error"))).otherwise(event("citations", F.to_json(F.coalesce("citations", F.array().cast("array<string>")))))
    rows = F.concat(F.array(event("status", F.lit("searching")), event("status", F.lit("answering"))), F.coalesce(tokens, F.array().cast("array<struct<type:string,data:string>>")), F.array(last))
    return answers.select(conversation, F.posexplode(rows).alias("seq", "event")).select(conversation, "seq", F.to_json("event").alias("event"))


def citations(retrieved: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, citations): slug and title of each row, by rank."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug", "title"))), lambda x: F.struct(x["slug"].alias("slug"), x["title"].alias("title")))
    return retrieved.groupBy(conversation).agg(rows.alias("citations"))


def replay_chain(replies: list[dict], models: list[str], budget: int = 8000, ceiling: int = 32_000, tries: int = 3) -> dict:
    """Which recorded reply a fallback chain ends with.

    A reply is {model, kind}, kind one of ok, truncated, invalid, rate_limited, failed.
    A truncated reply raises the budget fourfold up to the ceiling and is asked again;
    an invalid one gets one corrective try; a rate limit is waited out; whatever fails
    goes on to the next model.
    """
    left = list(replies)
    attempts = refunds = 0
    for place, model in enumerate(models):
        corrected = False
        for _ in range(tries):
            reply = next((r for r in left if r["model"] == model), None)
            if reply is None:
                break
            left.remove(reply)
            attempts += 1
            match reply["kind"]:
                case "ok":
                    return {"model": model, "attempts": attempts, "fell_back": place > 0, "budget": budget, "refunds": refunds}
                case "rate_limited":
                    refunds += 1
                case "truncated" if budget < ceiling:
                    budget = min(4 * budget, ceiling)
                case "invalid" if not corrected:
                    corrected = True
                case _:
                    break
    return {"model": None, "attempts": attempts, "fell_back": True, "budget": budget, "refunds": refunds}


def replay_stream(started: bool, failed: bool) -> str:
    """A stream falls back only before its first token."""
    return "done" if not failed else "interrupted" if started else "next_model"


def fallbacks(replies: DataFrame, models: list[str], budget: int = 8000, ceiling: int = 32_000, tries: int = 3, request: str = "request", seq: str = "seq") -> DataFrame:
    """replay_chain() of each request: (request, model, attempts, fell_back, budget, refunds).

    `replies` (request, seq, model, kind) are recorded; each request's are folded in the
    order of the models and, within one, of their numbers.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")) - 1
    asked = replies.where(place >= 0).groupBy(request).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(seq).alias("seq"), "model", "kind"))).alias("replies"))
    fields = ("place", "tried", "corrected", "dead", "attempts", "refunds", "budget", "model")
    first = [F.lit(-1).cast("long"), F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0), F.lit(budget), F.lit(None).cast("string")]
    state = lambda values: F.struct(*[v.alias(k) for k, v in zip(fields, values)])

    def step(acc: Column, r: Column) -> Column:
        new = r["place"] != acc["place"]
        tried = F.when(new, 0).otherwise(acc["tried"])
        corrected, dead = (F.when(new, False).otherwise(acc[k]) for k in ("corrected", "dead"))
        kind = r["kind"]
        more = (kind == "truncated") & (acc["budget"] < ceiling)
        again = (kind == "invalid") & ~corrected
        after = state(
            [
                r["place"],
                tried + 1,
                corrected | again,
                ~((kind == "ok") | (kind == "rate_limited") | more | again),
                acc["attempts"] + 1,
                acc["refunds"] + (kind == "rate_limited").cast("int"),
                F.when(more, F.least(acc["budget"] * 4, F.lit(ceiling))).otherwise(acc["budget"]),
                F.when(kind == "ok", r["model"]),
            ]
        )
        return F.when(acc["model"].isNotNull() | dead | (tried >= tries), acc).otherwise(after)

    done = asked.select(request, F.aggregate("replies", state(first), step).alias("x"))
    return done.select(request, "x.model", "x.attempts", (F.col("x.model").isNull() | (F.col("x.model") != models[0])).alias("fell_back"), "x.budget", "x.refunds")


def stream_outcome(started: Column, failed: Column) -> Column:
    """replay_stream() as a column: a stream falls back only before its first token."""
    return F.when(~failed, "done").when(started, "interrupted").otherwise("next_model")
