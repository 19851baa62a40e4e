"""Small inputs with known results, and sets of dependencies to compare."""

PERSONS = [
    ["Jim", '"Jimmy"', "Cricket", r"\N", r"\N", "33"],
    ["Stacy", r"\N", "Tailor", r"\N", r"\N", "22"],
    ["Bud", "T.", "Spencer", r"\N", r"\N", "66"],
    ["E.T.", r"\N", r"\N", r"\N", r"\N", "4"],
]
PLANETS = [
    ["E.T.", r"\N", "Home", r"\N", r"\N", "123124213"],
    ["Bud", "Spencer", "Earth", r"\N", r"\N", "0"],
    ["Jim", "Cricket", "Earth", r"\N", r"\N", "0"],
    ["Stacy", "Tailor", "Earth", r"\N", r"\N", "0"],
]
LETTERS = ["a0,b0,c0,d0", "a0,b0,c1,d1", "a0,b0,c1,d2", "a0,b1,c1,d0", "a1,b1,c1,d0"]
LETTERS_EXT = [
    "a0,b0,c0,d0,e0", "a0,b0,c1,d1,e1", "a0,b0,c1,d2,e2", "a0,b1,c1,d0,e3", "a1,b1,c1,d0,e4", "a2,b1,c1,d0,e5",
]


def ids(first, second):
    """Names like p3 or q0 to column ids: first letter table 0, second letter table 1."""
    base = {first: 0, second: 1 << 16}
    return lambda text: [base[t[0]] + int(t[1:]) for t in text.split()]


def ind_set(df):
    return {(tuple(r["dep"]), tuple(r["ref"])) for r in df.select("dep", "ref").collect()}


def expected_inds(column_ids, *inds):
    return {tuple(tuple(column_ids(side)) for side in ind.split("<")) for ind in inds}
