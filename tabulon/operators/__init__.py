"""Sheets as relations, their analysis, and the exports made from them."""
