"""Post-engagement analytics as Spark DataFrame jobs.

Sub-packages
    functions   column expressions (parsing, dates, text terms)
    sources     readers, writers, schemas, shared scratch folders
    operators   relational, extraction, descriptive and feature operators
    learning    Spark ML stages, splits, metrics, tuning
    explain     tree attribution, keyword and word influence
    streaming   incremental collection and scoring of streams
    plans       end-to-end flows built from the parts above
    catalog     registered queries over the given tables, with check SQL
"""

from resonance.session import get_session

__all__ = ["get_session"]
