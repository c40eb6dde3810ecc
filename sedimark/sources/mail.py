"""Raw mails to rows of the lore table, and back to mailboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.snip import snip_quotes
from ..functions.text import address, asctime, decode_base64_body, headers, mail_timestamp
from ..rows import map_rows

_RAW = "git_commit_sha string, `from` string, date string, message_id string, in_reply_to string, subject string, `references` string, recipients string, body string"


def parse_headers(raw: str) -> tuple[dict[str, str], str]:
    """Headers by lower-case name, folded lines joined, the first of a name; and the body."""
    head, _, body = raw.replace("\r\n", "\n").partition("\n\n")
    found: dict[str, str] = {}
    name = ""
    for line in head.split("\n"):
        if line[:1] in (" ", "\t"):
            if name:
                found[name] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            name = key.strip().lower()
            if name in found:
                name = ""
            else:
                found[name] = value.strip()
        else:
            name = ""
    return found, body


def _parse(sha: str | None, raw: str | None) -> list[tuple]:
    h, body = parse_headers(raw or "")
    to = ", ".join(h[k] for k in ("to", "cc") if h.get(k))
    return [(sha, h.get("from", ""), h.get("date", ""), h.get("message-id"), h.get("in-reply-to") or None, h.get("subject", ""), h.get("references") or None, to, body)]


def parse_mails(raw: DataFrame) -> DataFrame:
    """Rows of the lore table from (git_commit_sha, raw); mails without an id are left out.  Symbols come from diffs in bodies."""
    from ..extract.diffs import symbols_of_diff

    mails = map_rows(raw.select("git_commit_sha", "raw"), _parse, _RAW).where("message_id IS NOT NULL")
    symbols = F.pandas_udf(lambda s: s.map(lambda b: symbols_of_diff(b or "")), "array<string>")
    return mails.withColumn("date_timestamp", mail_timestamp(F.col("date"))).withColumn("symbols", symbols("body"))


def mbox_lines(mails: DataFrame, snip: bool = False) -> DataFrame:
    """(value): each mail as a mailbox entry, its body decoded, its quotations shortened if wanted."""
    body = decode_base64_body(F.col("body"))
    if snip:
        body = F.pandas_udf(lambda s: s.map(lambda b: snip_quotes(b or "")), "string")(body)
    stamp = asctime(F.timestamp_seconds("date_timestamp"))
    lines = headers(F.col("from"), F.col("date"), F.col("message_id"), F.col("subject"), F.col("recipients"), F.col("in_reply_to"))
    return mails.select(F.concat(F.lit("From "), address(F.col("from")), F.lit(" "), stamp, F.lit("\n"), lines, F.lit("\n\n"), body, F.lit("\n")).alias("value"))


def write_mbox(mails: DataFrame, path: str, snip: bool = False) -> None:
    mbox_lines(mails, snip).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; bodies are left out of tables that have them."""
    df.drop("body").write.mode("overwrite").json(path)
