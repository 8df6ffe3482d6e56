"""The action vocabulary as column expressions: classification, moves, id lists. All stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the action vocabulary.
BASE_SIZE, VOCAB_SIZE = 50257, 50291
EOT, CURSOR, END_OF_INPUT, DELETE, STOP = 50256, 50257, 50258, 50259, 50260
MOVE_START, MOVE_END = 50261, 50281  # end exclusive
RESERVED_START, RESERVED_END = 50281, 50291  # end exclusive
AMOUNTS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
IGNORE = -100


def is_move(t: Column) -> Column:
    return (t >= MOVE_START) & (t < MOVE_END)


def is_control(t: Column) -> Column:
    """A move or a delete."""
    return is_move(t) | (t == DELETE)


def is_insert(t: Column, dialect: str = "module") -> Column:
    """Whether an id inserts. Dialects: ``module`` 0..50255; ``tokenizer`` every id but end-of-text, structural,
    control and move ids; ``stats`` every id below 50257, the end-of-text id and negative ids too."""
    if dialect == "module":
        return (t >= 0) & (t < EOT)
    if dialect == "tokenizer":
        return (t != EOT) & ~((t >= CURSOR) & (t < MOVE_END))
    if dialect == "stats":
        return t < BASE_SIZE
    raise ValueError(f"unknown insert dialect {dialect!r}")


def is_special(t: Column) -> Column:
    return (t >= BASE_SIZE) & (t < VOCAB_SIZE)


def kind(t: Column, dialect: str = "module") -> Column:
    """insert, move, delete, end_of_response or other."""
    return F.when(is_insert(t, dialect), "insert").when(is_move(t), "move").when(t == DELETE, "delete").when(t == STOP, "end_of_response").otherwise("other")


def move_amount(t: Column, strict: bool = False) -> Column:
    """Signed amount of a move id; null for other ids, an error if ``strict``."""
    wrong = F.raise_error(F.concat(F.lit("no move id: "), t.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(is_move(t), _shift(t - MOVE_START)).otherwise(wrong)


def _shift(at: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, amount in reversed(list(enumerate(AMOUNTS))):
        out = F.when(at == 2 * i, F.lit(amount)).when(at == 2 * i + 1, F.lit(-amount)).otherwise(out)
    return out


def move_id(amount: Column, strict: bool = False) -> Column:
    """Id of a signed power of two up to 512; null for other amounts, an error if ``strict``."""
    out = F.raise_error(F.concat(F.lit("no move amount: "), amount.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    for i, a in reversed(list(enumerate(AMOUNTS))):
        out = F.when(amount == a, F.lit(MOVE_START + 2 * i)).when(amount == -a, F.lit(MOVE_START + 2 * i + 1)).otherwise(out)
    return out


def decompose(n: Column) -> Column:
    """Signed powers of two, largest first, that add up to ``n``; 512 repeats, 0 gives an empty array, null gives null."""
    size = F.abs(n).cast("int")
    sign = F.when(n < 0, F.lit(-1)).otherwise(F.lit(1))
    whole = F.array_repeat(F.lit(512), F.floor(size / 512).cast("int"))
    rest = F.filter(F.transform(F.array(*[F.lit(a) for a in reversed(AMOUNTS[:-1])]), lambda p: size.bitwiseAND(p)), lambda x: x != 0)
    return F.when(n.isNotNull(), F.transform(F.concat(whole, rest), lambda x: x * sign))


def reserved_ids() -> Column:
    return F.sequence(F.lit(RESERVED_START), F.lit(RESERVED_END - 1))


def move_ids() -> Column:
    return F.sequence(F.lit(MOVE_START), F.lit(MOVE_END - 1))


def control_ids() -> Column:
    return F.concat(F.array(F.lit(DELETE)), move_ids())


def clamp_ids(ids: Column) -> Column:
    """Ids clamped into the vocabulary."""
    return F.transform(ids, lambda t: F.least(F.greatest(t, F.lit(0)), F.lit(VOCAB_SIZE - 1)))


def violations(ids: Column) -> Column:
    """How many ids lie outside of the vocabulary."""
    return F.size(F.filter(ids, lambda t: (t < 0) | (t >= VOCAB_SIZE)))


def int_list(values: Column) -> Column:
    """Strings to ints, leaving out what is none."""
    return F.filter(F.transform(values, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def initial_inserts(ids: Column, cap: Column | None = None) -> Column:
    """Length of the leading run of inserts, within the first ``cap`` ids."""
    part = ids if cap is None else F.slice(ids, 1, F.greatest(F.least(F.size(ids), cap), F.lit(0)))
    first = F.array_position(F.transform(part, lambda t: ~is_insert(t)), F.lit(True))
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.size(part))


def prefix_length(ids: Column, given: Column, fixed: int | None = None, infer: bool = False, most: int | None = None) -> Column:
    """Prefix length: the sample's own, else ``fixed``, else inferred, else 0; at most ``most``, within the sequence."""
    found = F.coalesce(given, F.lit(fixed).cast("int"), initial_inserts(ids, F.lit(most) if most is not None else None) if infer else F.lit(0))
    capped = F.least(found, F.lit(most)) if most is not None else found
    return F.greatest(F.lit(0), F.least(capped, F.size(ids)))


def shift_inputs(ids: Column) -> Column:
    """Inputs of a sequence: end-of-input, then all but the last id. An empty sequence stays empty."""
    return F.when(F.size(ids) > 0, F.concat(F.array(F.lit(END_OF_INPUT)), F.slice(ids, 1, F.size(ids) - 1))).otherwise(F.slice(ids, 1, 0))


def mask_labels(ids: Column, prefix: Column) -> Column:
    """Labels: the ids, with the first ``prefix`` ignored."""
    return F.transform(ids, lambda t, i: F.when(i < prefix, F.lit(IGNORE)).otherwise(t))


def pad(ids: Column, size: Column | int, with_id: int) -> Column:
    """``ids`` cut or padded to ``size``."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(ids, F.array_repeat(F.lit(with_id), F.greatest(n - F.size(ids), F.lit(0)))), 1, n)
