"""The SQL dialect: lexer, parser, compiler to DataFrames, and statements."""
