"""lucerna: static evidence analytics over file trees and text tables, as Spark plans."""
