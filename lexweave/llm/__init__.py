"""Training-data operators: one module each, queries in ``queries.py``.

Nothing outside this subpackage imports it.  Conventions shared by all modules:

* words are runs of bytes other than the ASCII white space ``\\x20 \\x09-\\x0D``
  (what ``bytes.split()`` returns on UTF-8 text);
* a null text counts as an empty one unless an operator says otherwise;
* extra columns of the input are ignored or passed through; where they pass,
  helper columns get names that are free (``common.free_name``) or the row is
  kept in one struct, so any names may come.
"""
