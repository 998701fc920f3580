"""What names a message: its id within its mailbox."""

from __future__ import annotations

from pyspark.sql import DataFrame

MESSAGE_KEY = ["mailbox_id", "message_id"]


def message_key(*frames: DataFrame) -> list[str]:
    """The key columns that all frames have.

    Tables of one mailbox may leave ``mailbox_id`` out; ids are then unique by themselves.
    """
    return [c for c in MESSAGE_KEY if all(c in f.columns for f in frames)]


def join_on_message(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join by message; a missing mailbox is a mailbox of its own.  Key columns stay once."""
    keys = message_key(left, right)
    plain = right.select(*[right[k].alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in MESSAGE_KEY])
    same = plain["_right_message_id"] == left["message_id"]
    if "mailbox_id" in keys:
        same = same & plain["_right_mailbox_id"].eqNullSafe(left["mailbox_id"])
    if how in ("left_semi", "left_anti"):
        return left.join(plain, same, how)
    return left.join(plain, same, how).drop(*[f"_right_{k}" for k in keys])
