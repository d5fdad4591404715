"""Who and what an error event is about, read from its parsed payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.payload import tag_at, text_at, text_of
from tidewell.functions.text import blank_to_null, present

# Fixed value: the user keys, most specific first.
USER_KEYS = ["id", "username", "email"]


def user_id(user: Column) -> Column:
    """First filled user key, trimmed; empty if none."""
    return F.coalesce(*[blank_to_null(text_at(user, k)) for k in USER_KEYS], F.lit(""))


def stored_user_id(user: Column) -> Column:
    """The stored column keeps the text as sent: no trimming."""
    return F.coalesce(*[F.nullif(text_at(user, k), F.lit("")) for k in USER_KEYS], F.lit(""))


def device_id(tags: Column, contexts: Column, extra: Column) -> Column:
    """The device tag, else the device context, else the extra data; empty if none."""
    return F.coalesce(
        blank_to_null(tag_at(tags, "device_id")),
        blank_to_null(text_at(contexts, "device", "id")),
        blank_to_null(tag_at(extra, "device_id")),
        F.lit(""),
    )


def distinct_id(user: Column, device: Column) -> Column:
    return F.when(present(user), user).otherwise(device)


def distinct_source(user: Column, device: Column) -> Column:
    return F.when(present(user), "user.id").when(present(device), "device_id").otherwise("")


def named_version(contexts: Column, context: str) -> Column:
    """`name version` of the os or browser context; the version is optional, the name is not."""
    name = blank_to_null(text_at(contexts, context, "name"))
    version = blank_to_null(text_at(contexts, context, "version"))
    return F.when(name.isNotNull(), F.concat_ws(" ", name, version)).otherwise("")


def title(message: Column, exception: Column) -> Column:
    """The message, else type and value of the first exception; empty if none."""
    kind = F.nullif(text_at(exception, "values", 0, "type"), F.lit(""))
    value = F.nullif(text_at(exception, "values", 0, "value"), F.lit(""))
    text = F.nullif(text_of(message), F.lit(""))
    return F.coalesce(text, F.nullif(F.concat_ws(": ", kind, value), F.lit("")), F.lit(""))
