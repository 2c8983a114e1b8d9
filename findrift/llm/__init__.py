"""Training-data operators: ten stand-alone operators over text, pages, chats and vectors.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; ``queries`` holds the thin registered queries and their SQL.
"""
