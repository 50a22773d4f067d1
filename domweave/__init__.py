"""Page extraction, structure analysis and data quality as Spark jobs."""

from domweave.functions.selectors import Selector, css, xpath
from domweave.operators.analyze import analyze_pages, page_features, repeating_groups
from domweave.operators.dom import elements, parse_pages
from domweave.operators.extract import Field, extract_items
from domweave.operators.jobs import Extractors
from domweave.operators.similar import locators, similar_elements
from domweave.operators.validate import FieldRule, Relation, Schema, apply_validation, check_items, validate
from domweave.session import configure
from domweave.sources.pages import read_pages, stream_pages
from domweave.sources.writers import flatten, write_items

__all__ = [
    "Extractors", "Field", "FieldRule", "Relation", "Schema", "Selector", "analyze_pages", "apply_validation",
    "check_items", "configure", "css", "elements", "extract_items", "flatten", "locators", "page_features", "parse_pages",
    "read_pages", "repeating_groups", "similar_elements", "stream_pages", "validate", "write_items", "xpath",
]
