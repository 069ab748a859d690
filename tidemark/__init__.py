"""tidemark: DataFrame operators for dated obligations and news ranking on Spark."""

__version__ = "0.1.0"
