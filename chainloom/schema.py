"""Explicit schemas of everything read from files."""

from __future__ import annotations

from pyspark.sql import types as T

ATOMS = "chain_id string, split string, line bigint, atom_id int, atom string, alt string, res string, chain string, res_id int, ins_code string, x double, y double, z double, b_factor double"
PAIRS = T.StructType([
    T.StructField("prot1_pdb_id", T.StringType()), T.StructField("prot1_chain_id", T.StringType()),
    T.StructField("prot2_pdb_id", T.StringType()), T.StructField("prot2_chain_id", T.StringType()),
    T.StructField("tm_score", T.DoubleType()),
])
RESIDUE_LABELS = T.StructType([
    T.StructField("pdb_path", T.StringType()),
    T.StructField("epitope_label", T.ArrayType(T.IntegerType())),
    T.StructField("residue_index", T.ArrayType(T.IntegerType())),
])
#: Domain table fields in order and their types; the rest of a line is the description (a fixed format).
DOMAIN_FIELDS = (
    ("target_name", "string"), ("target_accession", "string"), ("tlen", "int"), ("query_name", "string"), ("query_accession", "string"),
    ("qlen", "int"), ("e_value", "double"), ("score", "double"), ("bias", "double"), ("domain_num", "int"), ("domain_of", "int"),
    ("dom_c_evalue", "double"), ("dom_i_evalue", "double"), ("dom_score", "double"), ("dom_bias", "double"), ("dom_from", "int"),
    ("dom_to", "int"), ("ali_from", "int"), ("ali_to", "int"), ("env_from", "int"), ("env_to", "int"), ("acc", "double"),
)
