"""Schemas of the relations that a match run reads and returns."""

from __future__ import annotations

INVOICE = "invoice_number string, vendor_name string, date string, amount string"
LEDGER = "reference string, vendor string, date string, debit string, credit string"
BLOCKS = "doc_id string, pos int, text string, bbox array<array<double>>, confidence double"
ASSIGNED = "batch_id long, invoice_idx long, ledger_idx long, score double"
