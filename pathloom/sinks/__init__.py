"""Writers: Parquet tables for work, text forms for interchange."""
