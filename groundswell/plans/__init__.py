"""The Bronze, Silver and Gold jobs and the registered queries."""
