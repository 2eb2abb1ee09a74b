"""Review actions: payloads made equal, applied in their order, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions import times as T
from ..functions.text import _col
from ..plans import lexicons as L

STATUS = {"approve": "approved", "reject": "rejected"}


def action_of(body: str | Column) -> Column:
    """struct<action, post_id, open_id, user_name, message_id, event_id, edited_content> of either payload shape; the value
    may be an object or a JSON string; the form's own key for the post goes before the old one."""
    b = _col(body)
    inner = F.coalesce(F.get_json_object(b, "$.event"), b)
    at = lambda path: F.get_json_object(inner, path)
    value = at("$.action.value")
    given = lambda *names: F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names])
    post = given("postId", "post_id")
    form = F.from_json(F.coalesce(at("$.action.form_value"), at("$.form_value"), F.lit("{}")), "map<string,string>")
    edited = F.coalesce(given("editedContent", "edited_content"), F.try_element_at(form, F.concat(F.lit("edited_content_"), post)), F.try_element_at(form, F.lit("edited_content")))
    return F.struct(
        F.get_json_object(value, "$.action").alias("action"), post.alias("post_id"), F.coalesce(at("$.operator.user_id.open_id"), at("$.operator.open_id"), at("$.open_id")).alias("open_id"),
        F.coalesce(at("$.operator.name"), at("$.operator.user_name")).alias("user_name"), F.coalesce(at("$.context.open_message_id"), at("$.open_message_id")).alias("message_id"),
        F.coalesce(F.get_json_object(b, "$.header.event_id"), F.get_json_object(b, "$.uuid")).alias("event_id"), edited.alias("edited_content"))


def history(posts: DataFrame, actions: DataFrame, *order: str) -> DataFrame:
    """What became of each post: a row for each action that changed it, with the post after it, valid_from (the order of that
    action, a struct) and valid_to (that of the next one; null for the present row), and a row of the post as it was, whose
    valid_from is null.

    Actions are applied one after another: approve and reject set status and reviewer; save_edit sets content, its length and
    the reviewer, if the edit is neither empty nor too long nor what the content is by then; others change nothing. What a
    post is after an action are the last values set so far, so one ordered pass over each post's actions does it. posts:
    post_id (unique), status, reviewed_by, content, char_count; actions: post_id, action, open_id, edited_content and the
    columns of the order.
    """
    from .guards import edit_refusal

    state = ("status", "reviewed_by", "content", "char_count")
    acts = actions.where(F.col("action").isin("approve", "reject", "save_edit")).select("post_id", "action", "open_id", "edited_content", F.struct(*order).alias("_at"))
    rows = acts.join(posts.select("post_id", *[F.col(c).alias(f"_{c}") for c in state]), "post_id")
    by = Window.partitionBy("post_id").orderBy("_at", "action", "edited_content")
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    # an edit that repeats the content sets nothing, but sets what is there: so the content is the last edit that could be one
    able = (F.col("action") == "save_edit") & edit_refusal("edited_content", F.lit(None).cast("string")).isNull()
    rows = rows.withColumn("_edit", F.when(able, X.stripped("edited_content")))
    before = F.coalesce(last("_edit", by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_content"))
    rows = rows.withColumn("_edits", F.coalesce(able & ~F.col("_edit").eqNullSafe(before), F.lit(False))).withColumn("_new", F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("action")])
    changes = F.col("_edits") | F.col("_new").isNotNull()
    rows = rows.withColumn("_who", F.when(changes, F.coalesce("open_id", F.lit(""))))
    content = last("_edit", by)
    after = rows.select(
        "post_id", F.coalesce(last("_new", by), F.col("_status")).alias("status"), F.coalesce(last("_who", by), F.col("_reviewed_by")).alias("reviewed_by"), F.coalesce(content, F.col("_content")).alias("content"),
        F.when(F.max("_edits").over(by), F.length(content)).otherwise(F.col("_char_count")).cast("int").alias("char_count"), F.col("_at").alias("valid_from"), changes.alias("_changes"))
    first = posts.select("post_id", "status", "reviewed_by", "content", F.col("char_count").cast("int").alias("char_count"), F.lit(None).cast(after.schema["valid_from"].dataType).alias("valid_from"))
    both = first.unionByName(after.where("_changes").drop("_changes"))
    return both.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("post_id").orderBy(F.asc_nulls_first("valid_from"))))


def applied(posts: DataFrame, actions: DataFrame, *order: str) -> DataFrame:
    """Posts after all their actions (see ``history``); columns that actions do not change stay as they are."""
    now = history(posts, actions, *order).where("valid_to IS NULL").drop("valid_from", "valid_to")
    return posts.drop("status", "reviewed_by", "content", "char_count").join(now, "post_id").select(*posts.columns)


def paused(actions: DataFrame, *order: Column) -> DataFrame:
    """One row: whether the newest of pause and resume is pause."""
    last = F.max_by("action", F.struct(*order))
    return actions.where(F.col("action").isin("pause", "resume")).agg(F.coalesce(last == "pause", F.lit(False)).alias("paused"))


def card(as_of: Column) -> Column:
    """A review card as JSON, from columns headline, category, risk_level, risk_reasons, topics, score, source_names,
    earliest, and posts (array of post_id, content_mode, content). Links go from pure news, whose length is what is shown."""
    shown = lambda p: F.when(p["content_mode"] == "pure_news", X.without_urls(p["content"])).otherwise(p["content"])
    posts = F.transform("posts", lambda p: F.struct(p["post_id"].alias("post_id"), X.label(p["content_mode"], L.MODE_BADGES).alias("badge"), F.length(shown(p)).alias("chars"), X.quoted(shown(p)).alias("text")))
    return F.to_json(F.struct(
        X.header_colour("risk_level").alias("template"), F.col("headline").alias("title"), X.label("category", L.CATEGORY_LABELS).alias("category"), X.one_decimal("score").alias("score"),
        F.array_join(F.slice(F.array_distinct("source_names"), 1, 3), ", ").alias("sources"), T.ago("earliest", as_of).alias("ago"), T.absolute("earliest").alias("at"),
        F.array_join(F.transform("topics", lambda t: X.label(t, L.TAG_LABELS)), "  ").alias("tags"),
        F.when(F.col("risk_level") != "low", F.array_join("risk_reasons", ", ")).alias("risk"), posts.alias("posts")))


def status_card(is_paused: Column, name: str = "The bot") -> Column:
    """The card that says whether posts are sent, as JSON, with the button that changes it."""
    either = lambda yes, no: F.when(is_paused, yes).otherwise(no)
    return F.to_json(F.struct(
        either("grey", "green").alias("template"), either("⏸ Bot Paused", "▶️ Bot Resumed").alias("title"),
        either(f"{name} is now **paused**. No new posts will be sent until you resume.", f"{name} is now **active**. New high-scoring posts will be sent.").alias("text"),
        F.struct(either("▶️ Resume Bot", "⏸ Pause Bot").alias("text"), either("primary", "default").alias("type"), either("resume_bot", "pause_bot").alias("action")).alias("button")))


def published(posts: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The posts of ids as posted, with the time and the link that opens a draft of their text."""
    out = posts.join(ids.select("post_id"), "post_id", "left_semi")
    return out.withColumn("status", F.lit("posted")).withColumn("posted_at", as_of).withColumn("intent_url", F.concat(F.lit("https://twitter.com/intent/tweet?text="), X.url_component("content")))
