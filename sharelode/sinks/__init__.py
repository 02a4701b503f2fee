"""Writers of tables and messages."""
