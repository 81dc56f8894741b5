"""From SQL text or statement objects to DataFrames: syntax tree, lexer, parser, scope, compiler."""
