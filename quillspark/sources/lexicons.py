"""Small lexicon tables written for this library; real ones are supplied as tables of the same columns.

They are fixed values: function words of the languages at hand, and a few word forms with made-up ratings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POS = [
    ("the", "DET"), ("a", "DET"), ("le", "DET"), ("la", "DET"), ("der", "DET"), ("die", "DET"), ("el", "DET"), ("los", "DET"),
    ("of", "ADP"), ("in", "ADP"), ("on", "ADP"), ("with", "ADP"), ("by", "ADP"), ("de", "ADP"), ("von", "ADP"), ("para", "ADP"),
    ("and", "CCONJ"), ("or", "CCONJ"), ("et", "CCONJ"), ("und", "CCONJ"), ("y", "CCONJ"),
    ("he", "PRON"), ("it", "PRON"), ("this", "PRON"), ("that", "PRON"), ("elle", "PRON"), ("sie", "PRON"), ("se", "PRON"),
    ("is", "VERB"), ("are", "VERB"), ("was", "VERB"), ("be", "VERB"), ("est", "VERB"), ("ist", "VERB"), ("es", "VERB"),
    ("tion", "NOUN"), ("ing", "NOUN"), ("ea", "NOUN"), ("ment", "NOUN"), ("heit", "NOUN"), ("re", "NOUN"),
    ("ble", "ADJ"), ("er", "ADJ"), ("lich", "ADJ"), ("ly", "ADV"), ("not", "ADV"), ("nicht", "ADV"), ("no", "ADV"),
]
STOP = ["the", "a", "of", "and", "in", "on", "to", "is", "it", "le", "la", "de", "et", "der", "die", "und", "el", "los", "y"]
LEMMAS = [("is", "be"), ("are", "be"), ("was", "be"), ("est", "être"), ("ist", "sein"), ("es", "ser"), ("los", "el"), ("die", "der"), ("la", "le")]
PRONOUNS = [("int", "that"), ("int", "this"), ("thrd", "he"), ("thrd", "it"), ("thrd", "elle"), ("thrd", "sie"), ("indef", "se"), ("fst", "i"), ("snd", "you")]
CONNECTORS = [("coordinating", "and"), ("coordinating", "or"), ("coordinating", "et"), ("coordinating", "und"), ("conditions", "if"), ("contrasts", "but"), ("addition", "with"), ("ordering", "then"), ("purpose", "for"), ("purpose", "para")]
RATINGS = [("kuperman", "the", 2.5), ("kuperman", "tion", 9.25), ("kuperman", "ing", 7.0), ("kuperman", "is", 3.0), ("shock", "the", 2.0), ("shock", "of", 2.75), ("bird", "and", 3.5), ("bird", "ea", 6.25)]
VALENCE = [("positive", "ble"), ("positive", "ly"), ("negative", "not"), ("negative", "no"), ("negative", "nicht"), ("strong", "is"), ("strong", "are"), ("active", "ing"), ("active", "er"), ("passive", "was")]
ENTITIES = [("GPE", "Thea"), ("ORG", "Of"), ("PERSON", "An"), ("PERSON", "Le"), ("DATE", "Es")]
#: Lists by the names of the indices that count them, and ratings by theirs.
CONNECTOR_LISTS = {"coordinating": "coord", "conditions": "cond", "contrasts": "contrast", "addition": "addition", "ordering": "order", "purpose": "reasonandpurpose"}
LISTS = [(f"Pron_{k}", w) for k, w in PRONOUNS] + [(f"Connector_{CONNECTOR_LISTS[k]}", w) for k, w in CONNECTORS] + [(f"Valence_{k}", w) for k, w in VALENCE]
EXPOSURE = [("AoE_inv_avg", "the", 0.25), ("AoE_inv_avg", "is", 0.5), ("AoE_inv_lin_reg_slope", "tion", 1.75), ("AoE_ind_above_thresh", "the", 3.0), ("AoE_ind_poly_fit_above", "of", 4.5), ("AoE_infl_point_poly", "and", 5.25), ("AoA_bristol", "of", 2.25), ("AoA_cortese", "in", 2.5)]
MEASURED = [(f"AoA_{m}", w, v) for m, w, v in RATINGS] + EXPOSURE

TABLES = {
    "lex_pos": ("word string, pos string", POS),
    "lex_stop": ("word string", [(w,) for w in STOP]),
    "lex_lemma": ("word string, lemma string", LEMMAS),
    "lex_pron": ("kind string, word string", PRONOUNS),
    "lex_conn": ("kind string, word string", CONNECTORS),
    "lex_rating": ("measure string, word string, value double", RATINGS),
    "lex_valence": ("list string, word string", VALENCE),
    "lex_list": ("list string, word string", LISTS),
    "lex_measured": ("measure string, word string, value double", MEASURED),
    "lex_entity": ("ent_type string, word string", ENTITIES),
}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table handed over as Arrow, so that Spark knows its size before it runs: of rows dealt out in tasks it doesn't, and would shuffle all tokens that are joined with them."""
    names = StructType.fromDDL(schema).names
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, columns, strict=True)}), schema)


def lexicon(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return local_table(spark, rows, schema)


def as_sql(name: str) -> str:
    """The same table as a common table expression: name(columns) AS (VALUES ...)."""
    schema, rows = TABLES[name]
    columns = ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))
    show = lambda v: str(v) if isinstance(v, float) else "'" + v + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)})"
