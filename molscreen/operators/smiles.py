"""SMILES text to molecular graphs, in one fold per distinct text.

A structure becomes an array of tokens, and everything the notation implies is carried along
them: the place in the text, the number of atoms, the atom that the next one attaches to at every
open branch (a stack as deep as the branches), the ring labels that are open, and the atoms and
bonds so far.  The first token that is wrong ends the fold.  Rows are shuffled as compact text;
tokens, atoms and bonds are never exploded, sorted or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molscreen.functions.validate import input_error
from molscreen.schemas import BOND_SYMBOLS, ELEMENT_ORDER, MAX_HEAVY_ATOMS
from molscreen.session import work_partitions

# --- fixed values: element symbols by atomic number ---
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
ATOMIC_NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)}

# --- fixed formats: the notation's own symbols ---
ORGANIC = "Cl|Br|[BCNOPSFI]|[bcnops]"
BOND = r"[-=#$:/\\]"
TOKEN = rf"{BOND}?(?:\[[^\[\]]*\]|{ORGANIC}|%[0-9]{{2}}|%\([0-9]{{1,4}}\)|[0-9])|."
# numbers of more than nine digits are no valid bracket
BRACKET = r"^\[([0-9]{0,9})([A-Z][a-z]?|[bcnops]|se|as)(@{0,2})(H[0-9]{0,9})?([+-][0-9]{1,9}|\++|-+)?(:[0-9]+)?\]$"

ORGANIC_SYMBOLS = ["Cl", "Br", *"BCNOPSFIbcnops"]
BOND_MARKS = "-=#$:/\\"
IMPLICIT = -1  # hydrogen count still to be derived from the valence


def _sql(value) -> str:
    return "r\"" + value + "\"" if isinstance(value, str) else str(value)


def _literal_map(value: Column, table: dict, default: int) -> Column:
    # one parsed literal instead of a call per entry keeps plan building quick
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), value), F.lit(default))


def element_number(symbol: Column) -> Column:
    """Atomic number of a symbol in either case, 0 when it is no element."""
    name = F.initcap(symbol)
    # the organic subset first: it is nearly every atom
    common = F.try_element_at(F.expr("map('C', 6, 'N', 7, 'O', 8, 'S', 16, 'F', 9, 'Cl', 17, 'Br', 35, 'I', 53, 'P', 15)"), name)
    every = F.expr("array(" + ", ".join(_sql(s) for s in SYMBOLS) + ")")
    return F.coalesce(common, F.array_position(every, name).cast("int"))


def element_code(number: Column) -> Column:
    """Feature code of an atomic number: its place in the element order, or ``other``."""
    return _literal_map(number, {ATOMIC_NUMBER[s]: i for i, s in enumerate(ELEMENT_ORDER[:-1])}, 9)


def bond_code(symbol: Column) -> Column:
    """Bond kind of a symbol; no symbol is 0 (unspecified)."""
    return _literal_map(symbol, BOND_SYMBOLS, 0)


def bond_order(kind: Column) -> Column:
    """Integer order: 2, 3, 4 for double to quadruple, 1 for everything else."""
    return F.when(kind.isin(2, 3, 4), kind).otherwise(1)


def is_aromatic_symbol(symbol: Column) -> Column:
    return symbol.rlike("^[a-z]")


def reconcile(opened: Column, closed: Column) -> Column:
    """Bond kind stated at two ring ends (null: not stated); null when they disagree."""
    return (
        F.when(closed.isNull(), opened)
        .when(opened == 0, closed)
        .when(opened == closed, opened)
    )


def _charge(text: Column) -> Column:
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    size = F.when(digits != "", digits.try_cast("int")).otherwise(F.length(text))
    return F.when(text == "", 0).otherwise(sign * size)


def _typed(words: Column) -> Column:
    """Token texts as structs of what each token says by itself."""

    def split(tok: Column, i: Column) -> Column:
        marked = (F.length(tok) > 1) & (F.instr(F.lit(BOND_MARKS), F.substring(tok, 1, 1)) > 0)
        return F.struct(i.alias("i"), F.length(tok).alias("width"), marked.alias("has_bond"), F.when(marked, F.substring(tok, 1, 1)).alias("mark"), F.when(marked, F.substring(tok, 2, 1000)).otherwise(tok).alias("body"))

    def kind(t: Column) -> Column:
        b = t["body"]
        first = F.substring(b, 1, 1)
        return (
            F.when(b.isin(ORGANIC_SYMBOLS), "atom")
            .when((first == "[") & b.endswith("]"), "bracket")
            .when(((first >= "0") & (first <= "9")) | ((first == "%") & (F.length(b) > 1)), "ring")
            .when(b == "(", "open")
            .when(b == ")", "close")
            .when(b == ".", "dot")
            .otherwise("bad")
        )

    def parts(t: Column) -> Column:
        # a bracket atom cut once: isotope, symbol, chirality, hydrogens, charge
        cut = F.array(*[F.regexp_extract(t["body"], BRACKET, n) for n in range(1, 6)])
        return F.struct(
            *[t[c].alias(c) for c in ("i", "width", "has_bond", "body")], kind(t).alias("kind"), bond_code(t["mark"]).alias("bond"),
            F.when(t["body"].startswith("["), cut).alias("parts"),
        )

    def told(t: Column) -> Column:
        k, b = t["kind"], t["body"]
        part = lambda n: F.get(t["parts"], F.lit(n - 1))
        bracket, is_atom = k == "bracket", k.isin("atom", "bracket")
        symbol = F.when(bracket, part(2)).otherwise(b)
        hs = F.when(part(4) == "", 0).when(part(4) == "H", 1).otherwise(F.substring(part(4), 2, 9).try_cast("int"))
        return F.struct(
            *[t[c].alias(c) for c in ("i", "width", "has_bond", "body", "kind", "bond")],
            is_atom.alias("is_atom"),
            F.when(is_atom, element_number(symbol)).alias("number"),
            F.when(is_atom, is_aromatic_symbol(symbol)).alias("aromatic"),
            F.when(bracket, _charge(part(5))).otherwise(0).alias("charge"),
            F.when(bracket, hs).otherwise(IMPLICIT).alias("hs"),
            F.when(bracket & (part(1) != ""), part(1).try_cast("int")).otherwise(0).alias("isotope"),
            F.when(bracket, F.length(part(3))).otherwise(0).alias("chirality"),
            # a bracket that does not match has an empty symbol
            F.when(bracket & (part(2) == ""), True).otherwise(False).alias("malformed"),
            F.when(k == "ring", F.regexp_replace(b, "[%()]", "").cast("int")).alias("label"),
        )

    return F.transform(F.transform(F.transform(words, split), parts), told)


ATOM = "struct<i:int,number:int,aromatic:boolean,charge:int,hs:int,isotope:int,chirality:int>"
LINK = "struct<i:int,a:int,b:int,kind:int,order_a:int,order_b:int>"
RING = "struct<label:int,atom:int,bond:int,i:int>"
ERROR = "struct<code:string,position:int,body:string>"


def _wrong(acc: Column, t: Column, anchor: Column, ring: Column) -> Column:
    """What is wrong at this token, in the order a reader would meet it; null if nothing."""
    k, before = t["kind"], acc["before"]
    starts = before.isin("", "dot")
    stated = F.when(t["has_bond"], t["bond"])
    return (
        F.when((k == "bad") & (t["body"] == "["), "unclosed_bracket")
        .when((k == "bad") & t["body"].rlike("^[A-Za-z]"), "unknown_element")
        .when(k == "bad", "unexpected_character")
        .when(t["malformed"], "malformed_bracket")
        .when(t["is_atom"] & (t["number"] == 0), "unknown_element")
        .when(t["is_atom"] & starts & t["has_bond"], "unexpected_character")
        .when((k == "open") & (starts | (before == "open")), "branch_at_start")
        .when((k == "close") & (acc["depth"] == 0), "unbalanced_paren")
        .when((k == "close") & before.isin("open", "dot"), "unexpected_character")
        .when((k == "dot") & starts, "unexpected_character")
        .when((k == "ring") & (starts | (before == "open")), "ring_at_start")
        .when(ring.isNotNull() & (ring["atom"] == anchor), "self_loop")
        .when(ring.isNotNull() & reconcile(ring["bond"], stated).isNull(), "ring_bond_mismatch")
    )


def _step(acc: Column, t: Column) -> Column:
    """The state after one more token."""
    k, top = t["kind"], F.size(acc["stack"])
    anchor = F.element_at(acc["stack"], -1)
    # the open end of this token's ring label
    ring = F.when(k == "ring", F.get(F.filter(acc["rings"], lambda r: r["label"] == t["label"]), F.lit(0)))
    code = _wrong(acc, t, anchor, ring)
    place = acc["at"] + t["width"] - F.length(t["body"])
    atom = F.struct(acc["n"].alias("i"), *[t[c].alias(c) for c in ("number", "aromatic", "charge", "hs", "isotope", "chirality")])
    grown = F.struct(t["i"].alias("i"), anchor.alias("a"), acc["n"].alias("b"), t["bond"].alias("kind"), t["i"].alias("order_a"), F.lit(-1).alias("order_b"))
    both = reconcile(ring["bond"], F.when(t["has_bond"], t["bond"]))
    closed = F.struct(t["i"].alias("i"), ring["atom"].alias("a"), anchor.alias("b"), both.alias("kind"), ring["i"].alias("order_a"), t["i"].alias("order_b"))
    opened = F.struct(t["label"].alias("label"), anchor.alias("atom"), t["bond"].alias("bond"), t["i"].alias("i"))
    first = acc["before"].isin("", "dot")
    lower = F.slice(acc["stack"], F.lit(1), top - 1)
    return F.struct(
        (acc["at"] + t["width"]).alias("at"),
        (acc["depth"] + F.when(k == "open", 1).when(k == "close", -1).otherwise(0)).alias("depth"),
        (acc["n"] + t["is_atom"].cast("int")).alias("n"),
        k.alias("before"),
        F.when(t["is_atom"], F.concat(lower, F.array(acc["n"])))
        .when(k == "open", F.concat(acc["stack"], F.array(anchor)))
        .when((k == "close") & (top > 1), lower)
        .otherwise(acc["stack"])
        .alias("stack"),
        F.when(k != "ring", acc["rings"])
        .when(ring.isNull(), F.concat(acc["rings"], F.array(opened)))
        .otherwise(F.filter(acc["rings"], lambda r: r["label"] != t["label"]))
        .alias("rings"),
        F.when(t["is_atom"], F.concat(acc["atoms"], F.array(atom))).otherwise(acc["atoms"]).alias("atoms"),
        F.when(t["is_atom"] & ~first, F.concat(acc["bonds"], F.array(grown)))
        .when(ring.isNotNull(), F.concat(acc["bonds"], F.array(closed)))
        .otherwise(acc["bonds"])
        .alias("bonds"),
        F.when(code.isNotNull(), F.struct(code.alias("code"), place.alias("position"), t["body"].alias("body"))).alias("error"),
    )


def _fold(tokens: Column) -> Column:
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit("").alias("before"), F.array(F.lit(None).cast("int")).alias("stack"),
        none(RING).alias("rings"), none(ATOM).alias("atoms"), none(LINK).alias("bonds"), F.lit(None).cast(ERROR).alias("error"),
    )
    return F.aggregate(tokens, start, lambda acc, t: F.when(acc["error"].isNotNull(), acc).otherwise(_step(acc, t)))


def parse(df: DataFrame, mol_id: str, smiles: str, distinct_texts: bool = False) -> DataFrame:
    """One row per distinct (id, text): atom and bond columns as arrays, or an error code.

    ``position`` is null for errors that belong to no single character.  Atom and bond
    order is input order; each bond is listed once, with the place of each end among its
    atom's neighbours (``order_a``, ``order_b``) so that chirality can be read later.
    Arrays are bounded: input is at most 1000 characters.

    A text is folded once, however many ids have it, and its result joined back.  With
    ``distinct_texts`` the caller has one id per text, and rows are folded where they lie.
    """
    rows = df.select(F.col(mol_id).alias("id"), F.col(smiles).alias("smiles"))
    # a fixed count: adaptive execution would merge these small rows into few tasks
    n = work_partitions(df.sparkSession)
    if distinct_texts:
        out = _read(rows.repartition(n, "id").dropDuplicates(["id", "smiles"]))
    else:
        # by a digest: over the texts' own partitioning no second exchange is planned, and the first one is merged
        texts = _read(rows.select("smiles").distinct().repartition(n, F.xxhash64("smiles"))).withColumnRenamed("smiles", "_text")
        out = rows.dropDuplicates(["id", "smiles"]).join(texts, F.col("smiles").eqNullSafe(F.col("_text"))).drop("_text")
    named = out.withColumnRenamed("smiles", smiles) if smiles != mol_id else out.drop("smiles")
    return named.withColumnRenamed("id", mol_id)


def _read(rows: DataFrame) -> DataFrame:
    """``rows`` (smiles, ...) with what every text says."""
    carried = rows.columns
    rows = rows.withColumn("bad_input", input_error(F.col("smiles")))
    words = F.when(F.col("bad_input").isNull(), F.regexp_extract_all("smiles", F.lit(TOKEN), F.lit(0)))
    # a generated column: no filter on its fields is moved below it with further copies of the fold
    folded = rows.select("*", F.explode_outer(F.array(_fold(_typed(words)))).alias("s"))
    error, n_atoms = F.col("s.error"), F.size("s.atoms")
    open_ring = F.element_at(F.sort_array(F.transform("s.rings", lambda r: F.struct(r["i"].alias("i"), r["label"].alias("label")))), -1)["label"]
    late = F.col("s.before") == "dot"
    code = (
        F.when(F.col("bad_input").isNotNull(), F.col("bad_input"))
        .when(error.isNotNull(), error["code"])
        .when(late, "unexpected_character")
        .when(n_atoms > MAX_HEAVY_ATOMS, "too_large")
        .when(F.col("s.depth") > 0, "unclosed_branch")
        .when(F.size("s.rings") > 0, "unclosed_ring")
    )
    out = folded.withColumn("error_code", code)
    is_code = lambda name: F.col("error_code") == name
    detail = (
        F.when(is_code("unclosed_branch"), F.concat(F.col("s.depth"), F.lit(" open")))
        .when(is_code("unclosed_ring"), F.concat(F.lit("label "), open_ring))
        .when(is_code("too_large"), F.concat(n_atoms, F.lit(" atoms")))
        .when(error.isNotNull(), error["body"])
        .when(late, ".")
    )
    placed = ~F.col("error_code").isin("unclosed_branch", "unclosed_ring", "too_large", "ring_bond_mismatch")
    position = F.coalesce(error["position"], F.when(late, F.col("s.at") - 1), F.when(F.col("bad_input") != "input_too_long", 0))
    ok = F.col("error_code").isNull()
    columns = ["number", "aromatic", "charge", "hs", "isotope", "chirality"]
    bond_columns = ["a", "b", "kind", "order_a", "order_b"]
    return out.select(
        *carried,
        F.when(ok, n_atoms).alias("n_atoms"),
        F.when(ok, F.size("s.bonds")).alias("n_bonds"),
        *[F.when(ok, F.col("s.atoms")[c]).alias(c) for c in columns],
        *[F.when(ok, F.col("s.bonds")[c]).alias(f"bond_{c}") for c in bond_columns],
        "error_code",
        F.when(placed, position).alias("position"),
        F.when(~ok, detail).alias("detail"),
    )


def atom_rows(parsed: DataFrame, mol_id: str, *columns: str) -> DataFrame:
    """One row per atom: (mol_id, atom, *columns) for any of the per-atom array columns."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return parsed.select(mol_id, F.posexplode(zipped).alias("atom", "_a")).select(mol_id, "atom", *[F.col("_a")[c].alias(c) for c in columns])


def bond_rows(parsed: DataFrame, mol_id: str) -> DataFrame:
    """One row per bond: (mol_id, a, b, kind), as listed."""
    zipped = F.explode(F.arrays_zip("bond_a", "bond_b", "bond_kind")).alias("_b")
    return parsed.select(mol_id, zipped).select(mol_id, *[F.col("_b")[f"bond_{c}"].alias(c) for c in ("a", "b", "kind")])


def error_text(smiles: Column, code: Column, position: Column) -> Column:
    """Error with the input and a caret under the offending character."""
    from molscreen.functions.validate import render_error

    at = F.when(position.isNotNull(), F.concat(F.lit(" at position "), position.cast("string"))).otherwise("")
    return F.when(code.isNotNull(), render_error(smiles, position, F.concat(F.replace(code, F.lit("_"), F.lit(" ")), at)))
