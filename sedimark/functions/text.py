"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

PRIMITIVES = (
    "void bool char short int long float double signed unsigned size_t ssize_t off_t time_t int8_t int16_t int32_t int64_t "
    "uint8_t uint16_t uint32_t uint64_t u8 u16 u32 u64 s8 s16 s32 s64 i8 i16 i32 i64 i128 u128 f32 f64 usize isize str String "
    "uintptr_t intptr_t ptrdiff_t wchar_t _Bool"
).split()

KEYWORDS = "if else for while do switch case default return break continue goto sizeof typeof struct union enum typedef static const volatile extern inline register".split()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(text, _ACCENTED, _FOLDED))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; those of more than 100 characters are left out."""
    return F.filter(F.split(fold(text), "[^0-9a-z]+", -1), lambda t: (t != "") & (F.length(t) <= 100))


def query_tokens(pattern: Column) -> Column:
    """An expression's letters and digits, for a search by tokens before the expression itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(pattern, r"[^\p{Alnum} ]", " "), " +", " "))


def mail_timestamp(date: Column) -> Column:
    """Seconds since 1970 of a mail's date; 0 where it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(date, r"^\s*\w+,\s*", ""), r"\s*\([^)]*\)\s*$", "")
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))), F.lit(0))


def asctime(timestamp: Column) -> Column:
    """As in the first line of a mail of a mailbox file."""
    day = F.lpad(F.dayofmonth(timestamp).cast("string"), 2, " ")
    return F.concat(F.date_format(timestamp, "EEE MMM "), day, F.date_format(timestamp, " HH:mm:ss yyyy"))


def address(sender: Column) -> Column:
    """What stands in angle brackets; the whole where none are."""
    inner = F.regexp_extract(sender, "<([^>]*)>", 1)
    return F.when(inner != "", inner).otherwise(F.trim(sender))


def decode_base64_body(body: Column) -> Column:
    """The decoded body where it is base64: three lines or more, two or more of 76 characters, nothing else in it, UTF-8 within."""
    lines = F.filter(F.split(F.regexp_replace(F.trim(body), "\r", ""), "\n"), lambda x: x != "")
    looks = (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: F.length(x) == 76)) >= 2) & F.forall(lines, lambda x: x.rlike("^[A-Za-z0-9+/]+={0,2}$"))
    decoded = F.try_validate_utf8(F.try_to_binary(F.array_join(lines, ""), F.lit("base64")).cast("string"))
    return F.when(looks, F.coalesce(decoded, body)).otherwise(body)


def headers(sender: Column, date: Column, message_id: Column, subject: Column, recipients: Column, in_reply_to: Column) -> Column:
    """A mail's header lines; those without a value are left out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    return F.concat_ws("\n", line("From", sender), line("Date", date), line("Message-ID", message_id), line("In-Reply-To", in_reply_to), line("To", recipients), line("Subject", subject))


def clean_type(name: Column) -> Column:
    """A type's bare name: no qualifiers, pointers, references or bounds, no struct, union or enum, no __words."""
    bare = F.regexp_replace(name, r"\[[^\]]*\]|[*&]|\b(const|volatile|static|extern|inline|struct|union|enum)\b|\b__\w+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def is_primitive(name: Column) -> Column:
    return F.forall(F.split(F.trim(name), r"\s+"), lambda w: w.isin(PRIMITIVES))


def type_variants(name: Column) -> Column:
    """A type's name with and without struct, union and enum."""
    bare = F.regexp_replace(name, "^(struct|union|enum) ", "")
    return F.array_distinct(F.array(name, bare, *(F.concat(F.lit(k + " "), bare) for k in ("struct", "union", "enum"))))


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & ~text.isin(KEYWORDS)


def called_names(line: Column) -> Column:
    """Names before an opening parenthesis, outside string literals; no keywords."""
    plain = F.regexp_replace(line, r'"(\\.|[^"\\])*"', '""')
    return F.filter(F.regexp_extract_all(plain, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1), lambda w: ~w.isin(KEYWORDS))


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def language(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin("c", "h", "cc", "cpp", "cxx", "c++", "hh", "hpp", "hxx", "h++"), "c").when(e == "rs", "rust").when(e == "py", "python").otherwise("unknown")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"^\./", "")


def code_for_embedding(text: Column, most_bytes: int = 8192) -> Column:
    """Code without attributes, exports, assembly and comments, white space collapsed, at most ``most_bytes`` of UTF-8."""
    x = F.regexp_replace(text, r"__attribute__\s*\(\([^)]*\)\)|EXPORT_SYMBOL\w*\s*\([^)]*\);|asm\s+volatile\s*\([^)]*\);?", "")
    x = F.regexp_replace(x, r"//[^\n]*", "")
    x = F.regexp_replace(x, r"/\*[\s\S]*?\*/", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), r"\n\s*\n\s*", "\n\n")
    # A cut in bytes that falls within a character drops all of it: continuation bytes at the end, then their first byte.
    head = F.substring(F.encode(x, "UTF-8"), 1, most_bytes)
    whole = F.coalesce(*(F.try_validate_utf8(F.substring(head, F.lit(1), F.length(head) - k).cast("string")) for k in range(4)), x)
    return F.trim(F.when(F.octet_length(x) <= most_bytes, x).otherwise(whole))
