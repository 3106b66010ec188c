"""prefspark: DataFrame-to-DataFrame operators for preference, chat, reward and
rollout tables, written against the public PySpark DataFrame / SQL API."""

__version__ = "0.1.0"
