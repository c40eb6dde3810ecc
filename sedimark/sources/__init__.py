"""Sources and sinks: git objects, mail, JSON and mailboxes."""
