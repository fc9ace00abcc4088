"""Keys, hashes and split assignment as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Salts and thresholds of the split assignment, the ranks of splits, and what counts as white space.
TRAIN_SALT = "doh-split-2026:"
IMAGE_SALT = "doh-vqa:"
SAMPLE_SALT = "doh-sample-v1:"
SPLIT_RANK = {"train": 0, "calibration": 1, "dev": 2, "test": 3}
WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
#: The characters of WHITE one by one.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"[\p{L}\p{N}_]+"


def _all_but_blanks(inside: str) -> str:
    """A pattern of the runs of a class of characters but for single blanks, which stay as they are: far fewer matches than runs."""
    return rf" [{inside}]+|[{inside}&&[^ ]][{inside}]*"


def digest(s: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(s, 256)


def casefold(s: Column) -> Column:
    """Lower case with sharp s written out and final sigma as sigma; see ``helpers.exact_casefold`` for all of Unicode."""
    return F.replace(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normalized(s: Column) -> Column:
    """Folded text with each run of white space as one blank."""
    return F.trim(F.regexp_replace(casefold(s), _all_but_blanks(WHITE[1:-2]), " "))


def fingerprint(s: Column) -> Column:
    """Digest of the folded words, which are runs of letters, digits and underscores."""
    return digest(F.trim(F.regexp_replace(casefold(s), _all_but_blanks("^" + WORD[1:-2]), " ")))


def hash_bucket(s: Column, n: Column | int = 100) -> Column:
    """The first eight hex digits of the digest, modulo ``n``."""
    return F.pmod(F.conv(F.substring(digest(s), 1, 8), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def train_split(group: Column, has_dev: Column | bool) -> Column:
    """Training rows of a source: a twentieth to calibration, another to dev if the source has none."""
    b = hash_bucket(F.concat(F.lit(TRAIN_SALT), group))
    dev = F.lit(has_dev) if isinstance(has_dev, bool) else has_dev
    return F.when(b < 5, "calibration").when((b < 10) & ~dev, "dev").otherwise("train")


def image_split(group: Column) -> Column:
    """A tenth to test, a twentieth to dev, the rest by :func:`train_split`."""
    b = hash_bucket(F.concat(F.lit(IMAGE_SALT), group))
    return F.when(b < 10, "test").when(b < 15, "dev").otherwise(train_split(group, True))


def family_split(key: Column) -> Column:
    """15 % test, 10 % dev, 10 % calibration."""
    b = hash_bucket(key)
    return F.when(b < 15, "test").when(b < 25, "dev").when(b < 35, "calibration").otherwise("train")


def official_split(named: Column, names: dict[str, str], group: Column, has_dev: bool) -> Column:
    """A source's own split under our names; its training rows are dealt by group, unknown names give null."""
    ours = F.lit(None).cast("string")
    for theirs, name in names.items():
        ours = F.when(named == theirs, train_split(group, has_dev) if name == "train" else F.lit(name)).otherwise(ours)
    return ours


def split_rank(split: Column) -> Column:
    """Rank by which components resolve their split."""
    out = F.lit(None).cast("int")
    for name, rank in SPLIT_RANK.items():
        out = F.when(split == name, rank).otherwise(out)
    return out


def split_name(rank: Column) -> Column:
    """The split of a rank."""
    return F.element_at(F.array(*map(F.lit, SPLIT_RANK)), rank.cast("int") + 1)


def family_signature(body: Column) -> Column:
    """Fingerprint with links and whole numbers masked, so texts of one template share it."""
    masked = F.regexp_replace(F.regexp_replace(body, r"https?://\S+", "X"), r"(?U)\b\d+\b", "X")
    return fingerprint(masked)


def sample_key(row_id: Column) -> Column:
    """Order key of reproducible samples."""
    return digest(F.concat(F.lit(SAMPLE_SALT), row_id))


def byte_key(content: Column) -> Column:
    """Key of a file's bytes."""
    return F.concat(F.lit("image-bytes:"), F.sha2(content, 256))


def pixel_key(width: Column, height: Column, pixels: Column) -> Column:
    """Key of decoded pixels: two files that show the same picture share it."""
    size = F.encode(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":")), "UTF-8")
    return F.concat(F.lit("pixels:"), F.sha2(F.concat(size, pixels), 256))


def canonical_json(*columns: str) -> Column:
    """One JSON text per distinct value: fields by name, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def remove_prefix(s: Column, prefix: str) -> Column:
    """``s`` without a leading ``prefix``."""
    return F.when(F.startswith(s, F.lit(prefix)), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def head(s: Column, n: int = 3000) -> Column:
    """The first ``n`` characters."""
    return F.substring(s, 1, n)


def stripped_length(s: Column) -> Column:
    """Characters without white space at either end."""
    return F.length(F.btrim(s, F.lit(BLANKS)))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Both tables by their keys, of which nulls are equal; keys are there once."""
    other = right.withColumnsRenamed({k: f"__other_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__other_{k}")) for k in keys), F.lit(True))
    return left.join(other, same, how).drop(*(f"__other_{k}" for k in keys))
