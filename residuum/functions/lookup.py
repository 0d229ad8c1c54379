"""Small lookup tables. Larger ones (random coil values, substitution scores) are parameters: DataFrames with the schemas below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: context (ala or pro), atom, resname, value; one row each.
COIL_SCHEMA = "context string, atom string, resname string, value double"
#: a, b, score; each unordered pair once.
SUBSTITUTION_SCHEMA = "a string, b string, score double"

# Water-to-interface transfer energies of residues (Wimley and White 1996).
HYDROPHOBICITY = {
    "ALA": 0.33, "ARG": 1.0, "ASN": 0.43, "ASP": 0.5, "CYS": 0.22, "GLN": 0.19, "GLU": 0.12, "GLY": 1.14, "HIS": -0.06, "ILE": -0.81,
    "LEU": -0.69, "LYS": 1.81, "MET": -0.44, "PHE": -0.58, "PRO": -0.31, "SER": 0.33, "THR": 0.11, "TRP": -0.24, "TYR": 0.23, "VAL": -0.53,
}

# Largest accessible surface of residues in square angstroms.
MAX_ASA = {
    "ALA": 121.0, "ARG": 265.0, "ASN": 187.0, "ASP": 187.0, "CYS": 148.0, "GLN": 214.0, "GLU": 214.0, "GLY": 97.0, "HIS": 216.0, "ILE": 195.0,
    "LEU": 191.0, "LYS": 230.0, "MET": 203.0, "PHE": 228.0, "PRO": 154.0, "SER": 143.0, "THR": 163.0, "TRP": 264.0, "TYR": 255.0, "VAL": 165.0,
}

# Shift of oxidised cysteine against the reduced one, by atom.
OXIDISED_CYS = {"H": 0.11, "HA": 0.16, "C": 0.0, "CA": -2.8, "CB": 13.1, "N": -0.2}

# The side chain's atoms after CB in order; chi1 is over N, CA, CB and the first, chi2 over CA, CB and the first two, and so on.
SIDE_CHAINS = {
    "ARG": ("CG", "CD", "NE", "CZ", "NH1"), "ASN": ("CG", "OD1"), "ASP": ("CG", "OD1"), "CYS": ("SG",), "GLN": ("CG", "CD", "OE1"), "GLU": ("CG", "CD", "OE1"),
    "HIS": ("CG", "ND1"), "ILE": ("CG1", "CD1"), "LEU": ("CG", "CD1"), "LYS": ("CG", "CD", "CE", "NZ"), "MET": ("CG", "SD", "CE"), "PHE": ("CG", "CD1"),
    "PRO": ("CG", "CD"), "SER": ("OG",), "THR": ("OG1",), "TRP": ("CG", "CD1"), "TYR": ("CG", "CD1"), "VAL": ("CG1",),
}

# Atoms around each aromatic ring in order, and the ring's intensity.
RINGS = {
    ("PHE", 1): (1.05, ("CG", "CD2", "CE2", "CZ", "CE1", "CD1")),
    ("TYR", 1): (0.92, ("CG", "CD2", "CE2", "CZ", "CE1", "CD1")),
    ("TRP", 1): (1.04, ("CD2", "CE3", "CZ3", "CH2", "CZ2", "CE2")),
    ("TRP", 2): (0.90, ("CG", "CD2", "CE2", "NE1", "CD1")),
    ("HIS", 1): (0.43, ("CG", "ND1", "CE1", "NE2", "CD2")),
}

# How strongly a ring acts on each kind of atom; the second table names other spellings.
RING_TARGETS = {"C": 1.0, "CA": 1.5, "CB": 1.0, "N": 1.0, "HA": 5.13, "HA2": 5.13, "HA3": 5.13, "H": 7.06}
ATOM_ALIASES = {"1H": "H", "1HA": "HA"}

# Residue names that stand for a standard one.
RESIDUE_ALIASES = {"CAS": "CYS", "CSD": "CYS", "CSO": "CYS", "HID": "HIS", "HIE": "HIS", "HIP": "HIS", "MSE": "MET"}


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def chi_table(spark: SparkSession) -> DataFrame:
    """``resname, chi, k, atom_name``: the four atoms of each chi."""
    rows = []
    for res, side in SIDE_CHAINS.items():
        path = ("N", "CA", "CB", *side)
        rows += [(res, chi, k, path[chi - 1 + k]) for chi in range(1, len(side) + 1) for k in range(4)]
    return table(spark, rows, "resname string, chi int, k int, atom_name string")


def ring_table(spark: SparkSession) -> DataFrame:
    """``resname, ring_no, intensity, corners, k, atom_name``."""
    rows = [(res, no, strength, len(atoms), k, a) for (res, no), (strength, atoms) in RINGS.items() for k, a in enumerate(atoms)]
    return table(spark, rows, "resname string, ring_no int, intensity double, corners int, k int, atom_name string")
