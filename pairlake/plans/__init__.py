"""All registered queries; importing the modules fills the registry."""

from pairlake.plans import (  # noqa: F401
    consensus,
    curation,
    families,
    flows,
    release,
    results,
    scoring,
    sources,
    streams,
    tables,
    text,
)
from pairlake.plans.registry import ORACLES, QUERIES, Tables  # noqa: F401
