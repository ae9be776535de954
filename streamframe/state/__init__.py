"""Named key-value stores: in memory, as tables, in SQLite, as versioned Parquet, relational, over JDBC."""

from .stores import InMemoryStore, JdbcStore, SqliteStore, Store, TableView, VersionedStore  # noqa: F401
