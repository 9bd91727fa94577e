"""Broad fields of subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The broad field of each subject.
BROAD_FIELDS = {
    "Chemistry": "Natural Sciences",
    "Physiology": "Medicine",
    "Physics": "Natural Sciences",
    "Biochemistry & Molecular Biology": "Biology",
    "Pharmacology & Pharmacy": "Medicine",
    "Neurosciences & Neurology": "Medicine",
    "Materials Science": "Engineering",
    "Microbiology": "Biology",
    "Endocrinology & Metabolism": "Medicine",
    "General & Internal Medicine": "Medicine",
    "Cardiovascular System & Cardiology": "Medicine",
    "Environmental Sciences & Ecology": "Environmental Sciences",
    "Engineering": "Engineering",
    "Thermodynamics": "Engineering",
    "Polymer Science": "Engineering",
    "Oncology": "Medicine",
    "Plant Sciences": "Environmental Sciences",
    "Behavioral Sciences": "Psychology and Social Sciences",
    "Life Sciences & Biomedicine - Other Topics": "Biology",
    "Developmental Biology": "Biology",
    "Psychology": "Psychology and Social Sciences",
    "Geology": "Earth Sciences",
    "Biotechnology & Applied Microbiology": "Biology",
    "Toxicology": "Medicine",
    "Anthropology": "Psychology and Social Sciences",
    "Health Care Sciences & Services": "Medicine",
    "Allergy": "Medicine",
    "Cell Biology": "Biology",
    "Astronomy & Astrophysics": "Natural Sciences",
    "Ophthalmology": "Medicine",
    "Genetics & Heredity": "Medicine",
    "Psychiatry": "Medicine",
    "Hematology": "Medicine",
    "Zoology": "Biology",
    "Fisheries": "Environmental Sciences",
    "Entomology": "Biology",
    "Pediatrics": "Medicine",
    "Infectious Diseases": "Medicine",
    "Optics": "Natural Sciences",
    "Nutrition & Dietetics": "Medicine",
    "Gastroenterology & Hepatology": "Medicine",
    "Rheumatology": "Medicine",
    "Oceanography": "Earth Sciences",
    "Research & Experimental Medicine": "Medicine",
    "Surgery": "Medicine",
    "Meteorology & Atmospheric Sciences": "Earth Sciences",
    "Anesthesiology": "Medicine",
}
OTHER = "Other"


def broad_fields(rows: DataFrame) -> DataFrame:
    """The lookup as a table of a fixed 47 rows."""
    return rows.sparkSession.createDataFrame(list(BROAD_FIELDS.items()), "subject string, field string")


def roll_up(rows: DataFrame, subject_col: str, out_col: str = "field") -> DataFrame:
    """Add the broad field of a subject; what the lookup lacks becomes ``Other``."""
    lookup = F.broadcast(broad_fields(rows).withColumnsRenamed({"subject": subject_col, "field": "_field"}))
    joined = rows.join(lookup, subject_col, "left")
    return joined.withColumn(out_col, F.coalesce("_field", F.lit(OTHER))).drop("_field")


def unmapped(rows: DataFrame, subject_col: str) -> DataFrame:
    """Subjects the lookup lacks, with their number of rows."""
    lookup = F.broadcast(broad_fields(rows).select(F.col("subject").alias(subject_col)))
    left_over = rows.where(F.col(subject_col).isNotNull()).join(lookup, subject_col, "left_anti")
    return left_over.groupBy(subject_col).agg(F.count("*").alias("n"))
