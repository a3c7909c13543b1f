"""Map collector records to named flow fields and bring them to their declared types.

Mapping table and field dictionary are parameters of a few hundred entries at most; they become literals of row-wise
map expressions, so mapping a record neither joins nor shuffles.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from biflux.runtime import once
from biflux.schemas import FlowDataError


def flags_to_number(flags: Column) -> Column:
    """TCP flag text such as ``.AP.S.`` -> bit mask: the last character is bit 0, a dot is an unset bit."""
    letters = F.reverse(F.filter(F.split(flags, ""), lambda c: c != ""))
    bits = F.transform(letters, lambda c, i: F.when(c != ".", F.pow(F.lit(2), i)).otherwise(0.0))
    return F.aggregate(bits, F.lit(0.0), lambda a, b: a + b).cast("long")


def strip_zeroes(text: Column) -> Column:
    """Trailing zero digits of a hex text, trailing NUL characters of any other text."""
    return F.when(text.rlike("^0x[0-9a-fA-F]*$"), F.regexp_replace(text, "0+$", "")).otherwise(F.regexp_replace(text, "\\x00+$", ""))


def literal_to_number(text: Column) -> Column:
    """Decimal or ``0x`` literal -> integer."""
    is_hex = text.rlike("^0[xX][0-9a-fA-F]+$")
    return F.when(is_hex, F.conv(F.substring(text, F.lit(3), F.length(text)), 16, 10).try_cast("long")).otherwise(text.try_cast("long"))


def lookup(table: dict[str, int | str]) -> Callable[[Column], Column]:
    """Converter from a table the user supplies (protocol names, algorithm numbers); unknown values give NULL."""
    pairs = F.create_map(*[F.lit(str(x)) for item in table.items() for x in item])
    return lambda value: F.try_element_at(pairs, value)


def converters(protocols: dict[str, int] | None = None, algorithms: dict[str, str] | None = None) -> dict[str, Callable[[Column], Column]]:
    """Registry of converter names; users may add theirs. All work on text and return text."""
    found = {
        "flags_to_hex": lambda v: flags_to_number(v).cast("string"),
        "rstrip_zeroes": strip_zeroes,
        "hex_to_int": lambda v: literal_to_number(v).cast("string"),
        "hex_to_lower": F.lower,
    }
    if protocols:
        found["protocol_identifier_to_number"] = lookup(protocols)
    if algorithms:
        found["tls_alg_nid_to_longname"] = lambda v: F.coalesce(lookup(algorithms)(v), F.lit(""))
    return found


def read_protocols(lines: list[str]) -> dict[str, int]:
    """Protocol table from lines in the usual ``/etc/protocols`` form: name, number, aliases, comment."""
    table = {}
    for line in lines:
        words = line.partition("#")[0].split()
        if len(words) >= 2:
            table.update({name: int(words[1]) for name in (words[0], *words[2:])})
    return table


@dataclass(frozen=True)
class Target:
    map: str
    converter: str | None = None


def check_mapping(raw: dict[str, dict], known: dict[str, Callable]) -> dict[str, Target]:
    """Validate a mapping table ``{key: {map, converter}}``."""
    table = {}
    for key, spec in raw.items():
        if "map" not in spec:
            raise FlowDataError(f"missing map attribute for key {key!r}")
        for name, value in spec.items():
            if name not in ("map", "converter"):
                raise FlowDataError(f"unexpected key {name!r} in mapping of {key!r}")
            if not isinstance(value, str):
                raise FlowDataError(f"value of {name!r} in mapping of {key!r} must be text")
        if "converter" in spec and spec["converter"] not in known:
            raise FlowDataError(f"converter {spec['converter']!r} of {key!r} not found")
        table[key] = Target(spec["map"], spec.get("converter"))
    parents = {t.map for t in table.values()}
    for target in parents:
        head = target.rpartition(".")[0]
        if head and head in parents:
            raise FlowDataError(f"attribute {head!r} is both a value and a structure")
    return table


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _is_one_of(name: Column, names: list[str]) -> Column:
    return name.isin(names) if names else F.lit(False)


def map_fields(records: DataFrame, table: dict[str, Target], known: dict[str, Callable], record: str = "record") -> DataFrame:
    """Rename and convert the entries of a ``map<string,string>`` column.

    Adds ``fields`` (the later of two entries with the same target wins), ``mapped`` and ``unmapped`` keys. The table is
    known when the plan is made, so each target becomes a lookup of its keys and the whole step compiles to Java.
    """
    source, keys = F.col(record), F.map_keys(record)
    by_target: dict[str, list[str]] = {}
    for key, target in table.items():
        by_target.setdefault(target.map, []).append(key)

    def value(key: str) -> Column:
        text = F.try_element_at(source, F.lit(key))
        return known[table[key].converter](text) if table[key].converter else text

    def entry(name: str, sources: list[str]) -> Column:
        if len(sources) == 1:
            return F.when(F.map_contains_key(source, sources[0]), F.struct(F.lit(name).alias("key"), value(sources[0]).alias("value")))
        found = F.array_max(F.array_compact(F.array(*[
            F.when(F.map_contains_key(source, k), F.struct(F.array_position(keys, k).alias("at"), value(k).alias("value"))) for k in sources])))
        return F.when(found.isNotNull(), F.struct(F.lit(name).alias("key"), found["value"].alias("value")))

    return records.withColumns({
        "fields": F.map_from_entries(F.array_compact(F.array(*[entry(n, ks) for n, ks in by_target.items()]))),
        "mapped": F.filter(keys, lambda k: _is_one_of(k, list(table))),
        "unmapped": F.filter(keys, lambda k: ~_is_one_of(k, list(table))),
    })


def unmapped_summary(mapped: DataFrame) -> DataFrame:
    """Keys without a mapping and the number of records that have them."""
    keys = mapped.select(F.explode_outer("unmapped").alias("key")).where(F.col("key").isNotNull())
    return keys.groupBy("key").agg(F.count("*").alias("records"))


TYPES = ("int", "string", "list", "dict")
# The direction of the reverse twin of a field.
OPPOSITE = {"always": "always", "any": "any", "forward": "reverse", "reverse": "forward"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    direction: str
    reverse: str | None = None


class FieldDictionary:
    """All supported fields with types and directions, reverse twins and subfields filled in."""

    def __init__(self, fields: dict[str, dict], key: list[str]):
        self.fields: dict[str, Field] = {}
        self._expand(fields, "")
        self.key = list(key)
        self.reverse_key = self.reversed_key(key)

    def _expand(self, fields: dict[str, dict], prefix: str) -> None:
        for name, spec in fields.items():
            self._expand(spec.get("subfields", {}), f"{name}.")
            if spec["type"] not in TYPES or spec["direction"] not in OPPOSITE:
                raise FlowDataError(f"invalid type or direction of field {name!r}")
            self.fields[prefix + name] = Field(prefix + name, spec["type"], spec["direction"], spec.get("reverse"))
            twin = spec.get("reverse")
            if twin:
                self.fields[twin] = Field(twin, spec["type"], OPPOSITE[spec["direction"]], prefix + name)

    def reversed_key(self, key: list[str]) -> list[str]:
        return [self.fields[k].reverse or k for k in key]

    def names(self, direction: str | None = None, type: str | None = None) -> list[str]:
        return [f.name for f in self.fields.values()
                if (direction is None or f.direction == direction) and (type is None or f.type == type)]

    def reverse_map(self) -> Column:
        return F.create_map(*[F.lit(x) for f in self.fields.values() for x in (f.name, f.reverse or f.name)])


def normalize(records: DataFrame, dictionary: FieldDictionary, column: str = "fields") -> DataFrame:
    """Keep known fields in their declared type (as text) and name the others in ``skipped``.

    List fields arrive as a JSON array (or one object); they go to ``lists`` as arrays of maps whose keys are the
    subfield names ``list.sub``. A mapped subfield ``list.sub`` alone becomes a list of one item.
    """
    ints = dictionary.names(type="int")
    list_names = dictionary.names(type="list")
    in_list = [n for n in dictionary.fields if n.partition(".")[0] in list_names]
    scalars = [n for n in dictionary.names() if n.partition(".")[0] not in list_names]
    source = F.col(column)

    def number(value: Column) -> Column:
        # Alternatives of an expected value (a JSON array) are read later.
        return F.when(~value.startswith("["), value.try_cast("bigint").cast("string")).otherwise(value)

    def typed(name: Column, value: Column) -> Column:
        return F.when(_is_one_of(name, ints), number(value)).otherwise(value)

    def taken(names: list[str]) -> Column:
        """A look-up per known name; only what is there goes through loops."""
        def found(some: list[str]) -> Column:
            entries = F.array(*[F.struct(F.lit(n).alias("key"), F.try_element_at(source, F.lit(n)).alias("value")) for n in some])
            return F.filter(entries, lambda e: e["value"].isNotNull())

        texts, numbers = [n for n in names if n not in ints], [n for n in names if n in ints]
        parts = [found(texts)] if texts else []
        if numbers:
            cast = F.transform(found(numbers), lambda e: F.struct(e["key"].alias("key"), number(e["value"]).alias("value")))
            parts.append(F.filter(cast, lambda e: e["value"].isNotNull()))
        return F.map_from_entries(F.concat(*parts)) if parts else F.create_map().cast("map<string,string>")

    kept = F.when(source.isNotNull(), taken(scalars))

    def listed(name: str) -> Column:
        text = F.try_element_at(source, F.lit(name))
        as_array = F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))

        def item(m: Column) -> Column:
            prefixed = F.transform_values(F.transform_keys(m, lambda k, v: F.concat(F.lit(f"{name}."), k)), typed)
            return F.map_filter(prefixed, lambda k, v: _is_one_of(k, in_list) & v.isNotNull())

        items = F.transform(F.from_json(as_array, "array<map<string,string>>"), item)
        single = F.filter(F.array(taken([n for n in in_list if n.startswith(f"{name}.")])), lambda m: F.size(m) > 0)
        return F.filter(F.coalesce(items, single), lambda m: F.size(F.map_keys(m)) > 0)

    lists = F.map_filter(
        F.map_from_arrays(_texts(list_names), F.array(*[listed(n) for n in list_names])),
        lambda k, v: v.isNotNull() & (F.size(v) > 0)) if list_names else F.lit(None).cast("map<string,array<map<string,string>>>")
    skipped = F.filter(F.map_keys(source), lambda k: ~F.map_contains_key(F.col("scalars"), k) & ~F.exists(
        F.map_keys(F.coalesce(F.col("lists"), F.create_map().cast("map<string,array<map<string,string>>>"))),
        lambda n: (k == n) | k.startswith(F.concat(n, F.lit(".")))))
    return once(records, {"scalars": kept, "lists": lists}).withColumn("skipped", skipped)


def normalize_annotations(annotations: DataFrame, dictionary: FieldDictionary) -> DataFrame:
    """Normalise expected flows with their optional ``forward`` and ``reverse`` sections."""
    rows = annotations
    for section in ("forward", "reverse"):
        if section in annotations.columns:
            rows = normalize(rows, dictionary, section).withColumnsRenamed(
                {"scalars": f"{section}_scalars", "lists": f"{section}_lists"}).drop("skipped", section)
    return normalize(rows, dictionary)


def is_biflow(dictionary: FieldDictionary, column: str = "scalars") -> Column:
    """A field of the reverse direction has a value (not zero, not empty)."""
    values = [F.try_element_at(F.col(column), F.lit(n)) for n in dictionary.names("reverse")]
    has = reduce(Column.__or__, [F.coalesce(~v.isin("", "0"), F.lit(False)) for v in values], F.lit(False))
    return F.when(F.col(column).isNotNull(), has)


EMPTY_VALUES, EMPTY_LISTS = "map<string,string>", "map<string,array<map<string,string>>>"


def direction_records(normalized: DataFrame, dictionary: FieldDictionary) -> DataFrame:
    """Add ``f`` and ``r``: the forward and, for a biflow, the reverse record with the names of their own direction.

    Each is a struct of ``values``, ``lists`` and ``fixed``. Optional columns ``forward_scalars``, ``forward_lists``,
    ``reverse_scalars`` and ``reverse_lists`` override the values of one direction; ``fixed`` names the fields that
    were given for the other direction only.
    """
    rename = dictionary.reverse_map()
    skip = {"f": dictionary.names("reverse"), "r": dictionary.names("forward")}

    def optional(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.create_map().cast(kind)) if name in normalized.columns else F.create_map().cast(kind)

    def side(source: str, kind: str, own: str, which: str) -> Column:
        base = F.map_filter(F.coalesce(F.col(source), F.create_map().cast(kind)), lambda k, v: ~_is_one_of(k, skip[which]))
        if which == "r":
            base = F.transform_keys(base, lambda k, v: F.coalesce(F.try_element_at(rename, k), k))
        if own not in normalized.columns:
            return base
        extra = optional(own, kind)
        return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)

    def record(which: str, own: str, other: str) -> Column:
        fixed = F.array_union(F.map_keys(optional(f"{other}_scalars", EMPTY_VALUES)), F.map_keys(optional(f"{other}_lists", EMPTY_LISTS)))
        return F.struct(
            side("scalars", EMPTY_VALUES, f"{own}_scalars", which).alias("values"),
            side("lists", EMPTY_LISTS, f"{own}_lists", which).alias("lists"), fixed.alias("fixed"))

    used = ["scalars", "lists", *[f"{d}_{k}" for d in ("forward", "reverse") for k in ("scalars", "lists")]]
    return once(once(normalized, {"biflow": is_biflow(dictionary)}), {
        "f": record("f", "forward", "reverse"), "r": F.when(F.col("biflow"), record("r", "reverse", "forward")),
    }).drop(*used)


def split_directions(normalized: DataFrame, dictionary: FieldDictionary) -> DataFrame:
    """One row per direction: ``side`` (fwd, rev), ``values``, ``lists``, ``fixed``."""
    pairs = direction_records(normalized, dictionary)
    keep = [c for c in pairs.columns if c not in ("f", "r")]
    sides = F.array(F.struct(F.lit("fwd").alias("side"), "f.*"), F.when(F.col("r").isNotNull(), F.struct(F.lit("rev").alias("side"), "r.*")))
    # The outer form does not evaluate the records a second time for an inferred filter.
    return pairs.select(*keep, F.inline_outer(F.array_compact(sides)))


def with_keys(records: DataFrame, dictionary: FieldDictionary, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``key`` and ``rev_key`` of the forward record and the direction-free ``bucket``; the second table has the
    records that lack a key field."""
    forward, backward = key or dictionary.key, dictionary.reversed_key(key) if key else dictionary.reverse_key
    keyed = records.withColumns({
        name: F.array(*[F.try_element_at(F.col("f.values"), F.lit(k)) for k in fields])
        for name, fields in (("key", forward), ("rev_key", backward))})
    missing = F.exists("key", lambda v: v.isNull())
    whole = keyed.where(~missing).withColumn("bucket", F.least("key", "rev_key"))
    return whole.withColumn("dir", F.when(F.col("key") == F.col("bucket"), 0).otherwise(1)), keyed.where(missing)
