"""molscreen: screening of small-molecule libraries as PySpark DataFrame jobs."""

__version__ = "0.1.0"


def version() -> dict[str, str]:
    """Package version and the feature-layout version it writes."""
    from molscreen.schemas import SCHEMA_VERSION

    return {"package": __version__, "feature_schema": str(SCHEMA_VERSION)}
