"""DataFrame operators: pages, selection, layout, cache, page planning, invoices."""
