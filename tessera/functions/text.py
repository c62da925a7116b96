"""Text and hash expressions with one definition for all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that str.isspace() accepts.
WS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Dialog tags.
ROLES = ("user", "assistant", "system")
#: Literal speaker marks and what they become.
MARKS = (("SYSTEM: ", "<|system|>\n"), ("USER: ", "\n<|user|>\n"), ("ASSISTANT: ", "\n<|assistant|>\n"), ("<|endoftext|>", ""))
EOS = 256


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode strip; null becomes the empty string."""
    return F.coalesce(F.btrim(col(c), F.lit(WS)), F.lit(""))


def nonempty(c: Column | str) -> Column:
    """Neither null nor empty, white space counting as text."""
    return F.coalesce(col(c) != "", F.lit(False))


def member_ci(c: Column | str, names: list[str]) -> Column:
    """Whether a stripped value is among the names, without case; any is if there are none."""
    wanted = {n.strip().lower() for n in names}
    return F.lower(strip(c)).isin(*sorted(wanted)) if wanted else F.lit(True)


def truncate(c: Column | str, max_chars: int) -> Column:
    return F.substring(strip(c), 1, max_chars) if max_chars > 0 else strip(c)


def first_truthy(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, stripped."""
    return strip(F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs]))


def n_tokens(c: Column | str) -> Column:
    """Byte tokens of a text and the end id; a null text has the end id alone."""
    return F.coalesce(F.octet_length(col(c)), F.lit(0)).cast("bigint") + 1


def md5_word(c: Column) -> Column:
    """The first 32 bits of the MD5 digest as a number."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")


def bucket10k(c: Column | str) -> Column:
    return md5_word(col(c)) % 10_000


def hash_split(c: Column | str, val_percent: float) -> Column:
    """'val' for a share of texts by content; the share is cut to hundredths of a percent."""
    return F.when(bucket10k(c) < int(val_percent * 100), "val").otherwise("train")


def normalize_role(c: Column | str) -> Column:
    r = F.lower(strip(c))
    return F.when(r.isin("assistant", "gpt", "model"), "assistant").when(r == "system", "system").otherwise("user")


def turn(role: Column, content: Column) -> Column:
    """One rendered turn; empty for blank content."""
    text = strip(content)
    return F.when(text == "", "").otherwise(F.concat(F.lit("<|"), normalize_role(role), F.lit("|>\n"), text, F.lit("\n")))


def dialog(turns: Column, role: str, content: str) -> Column:
    """An array of turns rendered in order; null if nothing is left."""
    return F.nullif(F.array_join(F.transform(turns, lambda t: turn(t[role], t[content])), ""), F.lit(""))


def exchange(user: Column, assistant: Column) -> Column:
    return F.concat(turn(F.lit("user"), user), turn(F.lit("assistant"), assistant))


def instruction(inst: Column, inp: Column, out: Column) -> Column:
    body = F.when(strip(inp) == "", strip(inst)).otherwise(F.concat(strip(inst), F.lit("\n\nInput:\n"), strip(inp)))
    return exchange(body, out)


def stop_hit(c: Column | str, stops: list[str], tail: int = 512) -> Column:
    end = F.right(col(c), F.lit(tail))
    hit = F.lit(False)
    for s in stops:
        hit = hit | F.contains(end, F.lit(s))
    return hit


def pretty_piece(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("Ġ", " "), ("▁", " "), ("Ċ", "\n"), ("\r\n", "\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def role_tags(c: Column | str) -> Column:
    """Literal speaker marks to dialog tags."""
    out = strip(c)
    for a, b in MARKS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def last_int(c: Column | str) -> Column:
    """The last whole number; null if there is none or it passes 64 bits."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(r"(-?\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")


def state_key(c: Column | str, prefix: str = "_orig_mod.") -> Column:
    """A parameter's name without a compiler's prefix, which goes once."""
    k = col(c)
    return F.when(F.startswith(k, F.lit(prefix)), F.substr(k, F.lit(len(prefix) + 1))).otherwise(k)


def kept_key(c: Column | str, drop: list[str]) -> Column:
    """Whether a parameter's name has none of the suffixes to drop."""
    ok = F.lit(True)
    for s in drop:
        ok = ok & ~F.endswith(col(c), F.lit(s))
    return ok
